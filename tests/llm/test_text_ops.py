"""Pure-Python parts against brute force: no session is needed."""

import random
import zlib

import numpy as np
import pytest

from oriel.llm import decontaminate as D
from oriel.llm import html_text as H
from oriel.llm import order_minhash as O
from oriel.llm import quality as Q
from oriel.llm import run_index as R
from oriel.llm import tokens as T
from oriel.llm import toxicity as X
from oriel.llm import url_filter as U


def texts(n=40, seed=1):
    r = random.Random(seed)
    words = ["a", "b", "c", "of", "the", "Ü", "é", "#x", "y,", "z."]
    out = [" ".join(r.choice(words) for _ in range(r.randint(0, 90))) for _ in range(n)]
    return out + ["", None, "x", "\n\n", "a\tb\x0bc", out[3] + " " + out[3], "the same line\n" * 7]


def test_quality_matches_brute_force():
    t = texts()
    got = Q.measure(t, 8)
    for i, x in enumerate(t):
        assert (got["n_words"][i], got["n_repeat_words"][i], got["n_covered"][i], got["longest_repeat"][i], got["n_dup_lines"][i]) == Q.brute_force(x)
    small = Q.measure(t, 8, block_bytes=50)
    assert all((small[k] == got[k]).all() for k in Q.COUNTS)


@pytest.mark.parametrize("length", [16, 23, 40])
@pytest.mark.parametrize("letters", ["ab", "abcé"])
def test_run_index_matches_a_table_of_windows(length, letters):
    r = random.Random(length)
    for trial in range(15):
        t = ["".join(r.choice(letters) for _ in range(r.randint(length, 150))).encode() for _ in range(r.randint(1, 7))]
        t += [t[0] * 2, t[-1][3:] + t[0]] if trial % 2 else []
        t = [x for x in t if len(x) >= length]
        seen = {}
        for x in t:
            for i in range(len(x) - length + 1):
                seen[x[i : i + length]] = seen.get(x[i : i + length], 0) + 1
        for x, ranges in zip(t, R.repeated_ranges(t, [1] * len(t), length), strict=True):
            got = {i for a, b in zip(ranges[::2], ranges[1::2], strict=True) for i in range(a, b + 1)}
            assert got == {i for i in range(len(x) - length + 1) if seen[x[i : i + length]] > 1}


def test_runs_compress_repetition():
    r = random.Random(5)
    one = bytes(r.randrange(97, 123) for _ in range(400))
    assert len(R.RunIndex([one] * 8).heads) < 1.2 * len(R.RunIndex([one]).heads) + 40


def test_runs_give_the_texts_back():
    r = random.Random(6)
    for letters in (2, 5, 256):
        t = [bytes(r.randrange(letters) for _ in range(r.randint(0, 90))) for _ in range(9)]
        t += [t[3], t[4] * 3, b"\0\0", b""]
        assert R.RunIndex(t).texts() == t


def test_equal_windows_have_equal_anchors():
    r = random.Random(2)
    shared = bytes(r.randrange(97, 101) for _ in range(260))
    a, b = bytes(r.randrange(97, 101) for _ in range(77)) + shared, shared + bytes(r.randrange(97, 101) for _ in range(90))
    found = []
    for t in (a, b):
        data, ends, text, offset = next(R.pieces([t], 200))
        first, last, p, h, c = R.contexts(data, ends)
        assert sum(last - first + 1) == len(t) - 199
        found.append({t[i : i + 200]: (int(k), int(q) - i) for f, e, q, k in zip(first, last, p, h, strict=True) for i in range(f, e + 1)})
    both = found[0].keys() & found[1].keys()
    assert len(both) == 61 and all(found[0][w] == found[1][w] for w in both)


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(R, "PIECE", 300)
    t = [bytes(random.Random(i).randrange(97, 100) for _ in range(n)) for i, n in enumerate((199, 200, 1000, 450))]
    starts = {i: set() for i in range(4)}
    for data, ends, text, offset in R.pieces(t, 200):
        first, last, p, h, c = R.contexts(data, ends)
        for f, e in zip(first, last, strict=True):
            starts[int(text[f])] |= set(range(int(f - offset[f]), int(e - offset[f]) + 1))
    assert [len(starts[i]) for i in range(4)] == [0, 1, 801, 251]


def test_merged_spans():
    assert R.merged_spans([5, 5, 0, 2, 300, 300], 200) == [(0, 205), (300, 500)]
    assert R.merged_spans(None, 200) == [] and R.merged_spans([0, 0, 200, 200], 200) == [(0, 400)]


def test_decontamination_windows():
    words = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen".split()
    long, short = " ".join(words), "Only Three Words"
    docs = [(1, f"x {long} y"), (2, "we say: only, three-words!"), (3, " ".join(words[:12])), (4, None), (5, ""), (6, "onlythree words")]
    items = [(7, long), (8, short), (9, None), (10, "!!")]
    machine = D.WindowMachine([(str(i), t) for i, t in items if t], 13)
    want = D.brute_force(docs, items)
    for (_, text), w in zip(docs, want, strict=True):
        n_words, hits, found = D.scanned(machine, text)
        assert (n_words, sum(b - a + 1 for a, b in hits), len(found)) == w[1:4]
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"row_a": 0, "row_b": i, "doc_id": d, "text": t} for i, (d, t) in enumerate(docs)])
    span = next(D.scan(iter([batch]), machine)).column("spans")[0].as_py()[0]
    assert docs[0][1][span["start"] : span["stop"]] == long


def test_windows_of_very_many_words():
    r = random.Random(3)
    words = [f"w{i}" for i in range(70_000)]
    items = [(str(i), " ".join(words[i * 100 : i * 100 + 100])) for i in range(700)]
    machine = D.WindowMachine(items, 13)
    pairs = [D.letters(k) for k in range(4 * D.BLOCK_WORDS)]
    assert len(set(pairs)) == len(pairs) and {p[0] for p in pairs}.isdisjoint(p[1] for p in pairs) and max(map(max, pairs)) < chr(0xD800)
    for i in (0, 553, 554, 699):
        at = i * 100 + r.randrange(80)
        assert D.scanned(machine, "x " + " ".join(words[at : at + 14]) + " y")[1:] == ([(1, 14)], [str(i)])


def test_bit_packing_round_trip():
    r = np.random.default_rng(1)
    for bits in (1, 7, 13, 16, 17, 20):
        ids = r.integers(0, 1 << bits, 1000).astype(np.uint32)
        counts = np.array([0, 400, 1, 599])
        f = T.whole_file(T.encode_file(np.arange(4), counts, ids, bits, block_ids=64))
        assert (f.ids(0, 1000) == ids).all() and (f.ids(63, 130) == ids[63:130]).all() and not len(f.ids(5, 5))
        assert (f.counts == counts).all() and len(T.pack(ids, bits)) == -(-1000 * bits // 8)


def test_encoder_is_the_library():
    code = T.Encoder(T.tokenizer_file())
    odd = ["", "Don't stop", "ΣΑΣ ΟΔΟΣ", "İstanbul", "a<|endoftext|>b", "x\x1cy z", "e\u0301a Ünï.", "don 't", "12,5 ... a.b,c", "日本 語", "\u00a0a\u2028b", "ǅ ŉ", "'s's 's", "A" * 300, "a\u0345 b"]
    for t in odd + [x for x in texts() if x]:
        assert code.text(t) == code.whole(t), t


def test_sketches_do_not_depend_on_the_batch():
    t = [x or "" for x in texts(60, 3)]
    h, n = O.word_hashes(t)
    labels, s = O.shingle_labels(h, n)
    keys, lanes = O.sketches(labels, s)
    k = 0
    for x, m in zip(t, s, strict=True):
        h1, n1 = O.word_hashes([x])
        l1, s1 = O.shingle_labels(h1, n1)
        k1, a1 = O.sketches(l1, s1)
        assert s1[0] == m and len(np.unique(l1)) == len(l1)
        if m:
            assert (k1[0] == keys[k]).all() and (a1[0] == lanes[k]).all()
            k += 1


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b):
            diagonal, row[j + 1] = row[j + 1], diagonal + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_alignment_is_a_common_subsequence():
    r = random.Random(4)
    for _ in range(200):
        base = [r.randrange(30) for _ in range(r.randint(5, 60))]
        other = [x if r.random() > 0.06 else r.randrange(30) for x in base]
        if r.random() < 0.3:
            other = other[:-3] + [1, 2]
        pair = [O.shingle_labels(*O.word_hashes([" ".join(map(str, x))]))[0] for x in (base, other)]
        n = lcs(pair[0].tolist(), pair[1].tolist())
        want = n / (len(pair[0]) + len(pair[1]) - n)
        assert O.aligned_similarity(*pair) == (pytest.approx(want) if want >= 0.8 else pytest.approx(0.0) if want < 0.75 else O.aligned_similarity(*pair))


def test_main_text():
    page = "<body><nav><ul><li><a href=x>Home</a></ul></nav><div class='ad'>Buy, now, here.</div><article><h1>Title</h1><p>One,&nbsp;two &amp; three.<p>Fo<b>ur</b>\n five.<br>Six</article><section id='comments'><p>No, no, no, no.</p></section><footer>&copy; x</footer>"
    assert H.main_text(page) == "Title One, two & three. Four five. Six"
    assert H.main_text(None) == H.main_text("") == H.main_text("<script>var a = '<p>x</p>'</script>") == ""
    assert H.main_text("<p>a" + "<div>" * 3000 + "b") != ""
    assert H.main_text('<div id=main><p>First, text, here.</p><p>More, of it.</p></div><div class="sidebar"><p>a, b, c, d, e, f, g, h, i</p></div>') == "First, text, here. More, of it."


def test_articles_are_not_lost_to_teasers():
    long = "This sentence goes on, and on, so that the paragraph has some length, as articles do in their middle parts. " * 3
    body = "".join(f"<p>{i} {long}</p>" for i in range(6))
    want = " ".join(" ".join(f"{i} {long}".split()) for i in range(6))
    assert H.main_text(f"<body><div class='content'>{body}</div><div class='more'><article><p>Teaser only</p></article></div></body>") == want
    assert H.main_text(f"<body><div class='page with-sidebar'><div>{body}</div></div><div class='sidebar-left'><p>{long}</p></div></body>") == want
    assert H.main_text(f"<body><article>{body}<pre><code><span class='comment'>code, said</span></code></pre></article></body>") == want + " code, said"
    assert H.main_text(f"<body><main><h2 class='share-title'>Head</h2>{body}</main><section class='comments'><p>{long}</p></section></body>") == "Head " + want


def slow_main_text(html):
    """The scorer again, over a tree, each figure by its own sum; for pages whose tags are all closed."""
    from html.parser import HTMLParser

    class Tree(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.at = self.root = {"tag": "html", "up": None, "kids": []}

        def handle_starttag(self, tag, attrs):
            node = {"tag": tag, "up": self.at, "kids": [], "names": dict(attrs).get("class") or ""}
            self.at["kids"].append(node)
            self.at = node

        def handle_endtag(self, tag):
            self.at = self.at["up"]

        def handle_data(self, data):
            self.at["kids"].append(data)

    tree = Tree()
    tree.feed(html)
    out, nodes, held = [], [tree.root], []  # out: (owner, text, linked characters)

    def up(n):
        while n is not None:
            yield n
            n = n["up"]

    def flush(owner):
        text = " ".join("".join(x for x, _ in held).split())
        if text:
            out.append((owner, text, min(sum(len(x.strip()) for x, link in held if link), len(text))))
        held.clear()

    def walk(n, owner, link):
        for k in n["kids"]:
            if isinstance(k, str):
                held.append((k, link))
                continue
            block = k["tag"] in H.BLOCKS
            if block:
                flush(owner)
            if k["tag"] not in H.LEFT_OUT and not H.side_name(k["tag"], k["names"]):
                nodes.append(k)
                walk(k, k if block else owner, link or k["tag"] == "a")
            if block:
                flush(k)
        if n is tree.root:
            flush(owner)

    walk(tree.root, tree.root, False)
    if not out:
        return ""
    inside = lambda n: [b for b in out if any(x is n for x in up(b[0]))]

    def value(n):
        score = 0.0
        for owner, text, _ in out:
            points = 1 + text.count(",") + min(len(text) // 100, 3)
            start = owner if owner["tag"] in ("div", "section", "article", "main", "body", "td", "html") else owner["up"]
            for level, x in enumerate(up(start)):
                if x is n:
                    score += points * (1, 0.5, 0.25)[level] if level < 3 else points / (2 * level)
        mine = inside(n)
        return score * (1 - sum(b[2] for b in mine) / sum(len(b[1]) for b in mine))

    able = [n for n in nodes if inside(n) and n["tag"] not in ("p", "a", "li")]
    best = max(able, key=lambda n: (round(value(n), 9), n["tag"] in ("article", "main")))
    articles = [n for n in nodes if n["tag"] in ("article", "main") and inside(n)]
    size = lambda n: sum(len(b[1]) for b in inside(n))
    top = next((n for n in up(best) if any(n is a for a in articles)), None)
    near = top
    if top is None:
        some = [a for a in articles if value(a) >= 0.5 * value(best) or size(a) >= 0.5 * size(best)]
        near = max(some, key=value, default=None)
        top = near or best
    chosen = [top]
    for n in nodes:
        if n["up"] is top["up"] and n is not top and top["up"] is not None and inside(n):
            few = sum(b[2] for b in inside(n)) / size(n) < 0.25
            if (n["tag"] == top["tag"] or n["tag"] in ("div", "section", "article")) and value(n) >= max(10.0, 0.2 * value(top)) or n["tag"] == "p" and size(n) > 80 and few and near is None:
                chosen.append(n)
    return " ".join(text for owner, text, _ in out if any(x is c for x in up(owner) for c in chosen))


def test_main_text_matches_a_slow_scorer():
    r = random.Random(11)
    words = ["one", "two,", "three", "a &amp; b", "four,", "five."]

    def text(n):
        return " ".join(r.choice(words) for _ in range(r.randint(1, n)))

    def element(depth):
        kind = r.random()
        if depth > 3 or kind < 0.4:
            link = f' <a href="x">{text(6)}</a> ' if r.random() < 0.3 else ""
            return f"<p>{text(80)}{link}{text(9)}</p>"
        if kind < 0.5:
            return "<ul>" + "".join(f'<li><a href="x">{text(4)}</a></li>' for _ in range(r.randint(1, 5))) + "</ul>"
        if kind < 0.58:
            return f"<nav><p>{text(9)}</p></nav><aside><div><p>{text(30)}</p></div></aside>"
        tag = r.choice(["div", "div", "section", "article", "main"])
        name = r.choice(["", ' class="content"', ' class="sidebar"', ' class="post with-comments"', ' class="adTop"', ' class="comment-body"'])
        return f"<{tag}{name}>" + "".join(element(depth + 1) for _ in range(r.randint(1, 4))) + f"</{tag}>"

    for _ in range(300):
        page = "<body>" + "".join(element(0) for _ in range(r.randint(1, 5))) + "</body>"
        assert H.main_text(page) == slow_main_text(page), page


def test_segments_are_the_cheapest_of_all():
    import math

    r = random.Random(5)
    counts = {w: r.randint(1, 50) for w in ("a", "ab", "b", "abc", "ca", "bca", "cc")}
    total = sum(counts.values()) + len(counts) + 1

    def cost(w):
        return -math.log((counts[w] + 1) / total) if w in counts else math.log(total) + U.UNKNOWN_LETTER * len(w)

    def every(t):
        return [[t[:i], *rest] for i in range(1, len(t) + 1) for rest in every(t[i:])] if t else [[]]

    for _ in range(150):
        t = "".join(r.choice("abcx") for _ in range(r.randint(0, 9)))
        costs = {(i, j): cost(t[i:j]) for i in range(len(t)) for j in range(i + 1, len(t) + 1) if t[i:j] in counts}
        got = U.best_split(t, costs, math.log(total))
        assert "".join(got) == t and sum(map(cost, got)) == pytest.approx(min(sum(map(cost, x)) for x in every(t)))


def test_toxic_grammar():
    g = X.Grammar({"idiot.": 7.0, "achlich": 3.0, "kill.": 2.0})
    kinds = {t: g.clause(t)[0] for t in ("an idiot here", "you idiot", "idiot you", "not an idiot", "they said idiot", "an idiot he said", "i will kill", "kill you", "nothing", "idiotic")}
    assert kinds == {"an idiot here": 0, "you idiot": 1, "idiot you": 1, "not an idiot": 2, "they said idiot": 3, "an idiot he said": 3, "i will kill": 4, "kill you": 5, "nothing": -1, "idiotic": -1}
    assert g.clause("der achlicher mann")[0] == 0 and not g.features(None).any() and g.features("Clean, words.")[0] == 0
    assert g.features("You IDIOT!")[0] == 1
    # A word that is a cue and learnt stands for both.
    assert g.clause("kill you") == (5, pytest.approx(1.0 + 2.0)) and g.clause("you kill") == (5, pytest.approx(2.0 + 1.5 * 2.0))
    assert g.clause("you idiot")[1] > g.clause("an idiot")[1] > g.clause("said idiot")[1] > g.clause("not an idiot")[1] > 0


def test_grammar_weights_match_its_machines_one_by_one():
    r = random.Random(9)
    g = X.Grammar({"idiot.": 7.0, "kill.": 2.0, "fool": 1.5})
    words = ["idiot", "foolish", "kill", "burn", "you", "not", "said", "plain", "never", "tu"]
    for _ in range(600):
        line = [r.choice(words) for _ in range(r.randint(0, 8))]
        told, score = set(), []
        states = [m.start for m in X.machines()]
        for w in line:
            cues = [s for s, listed in (("T", X.TARGETS), ("N", X.NEGATIONS), ("R", X.REPORTS), ("H", X.THREATS)) if w in listed]
            learnt = {"idiot": 7.0, "kill": 2.0, "foolish": 1.5}.get(w, 0.0)
            for s, own in [(c, float(c == "H")) for c in cues] + ([("I", learnt)] if learnt else []):
                for k, m in enumerate(X.machines()):
                    if (states[k], s) in m.arcs:
                        states[k], w_ = m.arcs[states[k], s]
                        own *= w_
                score.append(own)
        for k, m in enumerate(X.machines()):
            told |= {m.tells[states[k]]} if states[k] in m.tells else set()
        kind, got = g.clause(" ".join(line))
        bad = told & {"insult", "threat"}
        want = -1 if not bad else 3 if "reported" in told else 2 if "negated" in told else (4 if "threat" in told else 0) + ("targeted" in told)
        assert kind == want and got == pytest.approx(sum(score) if bad else 0.0), line


def test_crc_of_ids():
    assert zlib.crc32(np.array([2], "<u4")) == zlib.crc32(b"\x02\0\0\0")


def test_best_untested_partners_are_proposed():
    import numpy as np

    from oriel.llm import order_minhash as m

    # Two classes of four texts each; text 4 is most like text 0, then 1, 2 and 3.
    lanes = np.zeros((8, 48), np.uint8)
    for i in range(8):
        lanes[i, 40:] = i + 1
    for i in range(4):
        lanes[i, : 4 * i] = 100 + i
    lanes[5:, :40] = 50
    node, group, size = np.arange(8), np.array([0] * 4 + [4] * 4), np.full(8, 100.0)
    pairs = lambda *x: set(zip(*(p.tolist() for p in m.nearest(node, group, size, lanes, 1, *x)), strict=True))
    assert {(0, 4), (1, 4), (2, 4)} <= pairs()
    assert (0, 4) not in (got := pairs([[4], None, None, None, [0], None, None, None])) and {(1, 4), (2, 4), (3, 4)} <= got


def test_grammar_is_run_on_words_after_other_punctuation():
    from oriel.llm.toxicity import Grammar

    g = Grammar({"idiot": 3.0, "isn't.": 2.0})
    for text in ("¡idiota!", "“idiot”", "«idiot»", "so—idiot", "du\u00a0idiot", "isn't"):
        assert g.clause(text)[1] > 0 and g.features(text)[0] == 1, text
    assert g.features("¡clean!")[0] == 0


def test_deep_and_unclosed_markup_takes_linear_time():
    import time

    from oriel.llm import html_text

    for tag in ("<div>", "<span>", "<b><div>", "<i>", "<table><tr><td>"):
        took = []
        for n in (2000, 16_000):
            html = "<body>" + "".join(f"{tag}<p>some words, here and there {i}</b></i>" for i in range(n))
            began = time.perf_counter()
            text = html_text.main_text(html)
            took.append(time.perf_counter() - began)
        assert text and took[1] < 40 * max(took[0], 0.02)  # eight times the page; 64 times if it grew with the square


def test_pairs_of_a_block_are_those_that_bounds_leave():
    import time

    import numpy as np

    from oriel.llm import order_minhash as m

    rng = np.random.default_rng(3)

    def rows(n, blocks):
        size = rng.integers(5, 40, n)
        return rng.integers(0, blocks, n), np.arange(n), rng.integers(0, n // 2, n), size, rng.integers(0, 8, n), rng.integers(-1, 3, n), rng.integers(0, 4, (n, 2)).astype(np.uint64)

    for _ in range(20):
        block, node, group, size, place, part, bits = rows(60, 4)
        want = set()
        for i in range(60):
            for j in range(i):
                near = 9 * min(size[i] - place[i], size[j] - place[j]) >= 4 * (size[i] + size[j])
                apart = sum(bin(int(x)).count("1") for x in bits[i] ^ bits[j])
                meet = block[i] == block[j] and group[i] != group[j] and (part[i] != part[j] or part[i] < 0)
                if meet and near and 9 * apart <= size[i] + size[j]:
                    want.add((j, i))
        assert {tuple(x) for x in m.rare_pairs(block, node, group, size, place, part, bits).tolist()} == want
    n = 8000
    random = rng.integers(0, 1 << 63, (n, 2)).astype(np.uint64)
    start = time.time()
    got = m.rare_pairs(np.zeros(n, np.int64), np.arange(n), np.arange(n), rng.integers(80, 120, n), np.zeros(n, np.int64), np.full(n, -1), random)
    assert len(got) < 0.05 * n * (n - 1) / 2 and time.time() - start < 10
    none = np.empty(0, np.int64)
    assert not len(m.rare_pairs(none, none, none, none, none, none, np.empty((0, 2), np.uint64)))
