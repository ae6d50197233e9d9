"""Operators and the pipeline on small tables: odd rows, repeated rows, empty tables, clashing columns."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from oriel.llm import decontaminate, html_text, lines, mixing, order_minhash, quality, queries, run_index, tokens, toxicity, url_filter
from oriel.llm.graph import components
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(60))
NEAR = LONG.replace("word30", "other")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, size long, row long, key long, rank long, rep long, taken long, start long, anchor long, h long, at long"
ROWS = [(1, LONG), (2, LONG), (3, NEAR), (4, None), (5, ""), (6, " \n"), (7, "short"), (2, LONG), (8, "Ein Satz.\n" * 9), (None, LONG + " null"), (9, LONG + "\n" + NEAR)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "en", None if i == 3 else f"s{i % 3}", *[None] * 12) for i, r in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, LONG), (2, "short"), (3, None)], "item_id long, text string")


OPERATORS = {
    "decontaminate": lambda d, b, l: decontaminate.decontaminate(d, b),
    "exact": lambda d, b, l: run_index.exact_dedup(d),
    "quality": lambda d, b, l: quality.quality_rules(d),
    "toxicity": lambda d, b, l: toxicity.score_toxicity(d, l),
    "mix": lambda d, b, l: mixing.mix(d),
    "tokens": lambda d, b, l: tokens.token_output(d),
    "lines": lambda d, b, l: lines.line_dedup(d),
    "near": lambda d, b, l: order_minhash.near_duplicate_classes(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row_and_none_for_none(spark, docs, bench, name):
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    got = Counter(r["doc_id"] for r in OPERATORS[name](docs, bench, labels).collect())
    want = Counter(r[0] for r in ROWS)
    assert got == want
    assert OPERATORS[name](docs.limit(0), bench.limit(0), labels.limit(0)).count() == 0


def test_exact_dedup_matches_brute_force(spark, docs):
    for wide in (run_index.WIDE, 1):
        got = Counter(tuple(r)[1:5] for r in run_index.exact_dedup(docs, wide=wide).collect())
        assert got == Counter(run_index.brute_force([t for _, t in ROWS]))


def test_wide_anchors_are_cut_anew(spark):
    r = random.Random(8)
    shared = "".join(r.choice("abcdefgh ") for _ in range(190))
    parts = ["".join(r.choice("abcdefgh ") for _ in range(60)) for _ in range(6)]
    texts = [r.choice(parts)[-k:] + shared + r.choice(parts)[:k] + "".join(r.choice("xyz") for _ in range(9)) for k in (4, 9, 12, 30) for _ in range(25)]
    texts += [shared + parts[0], shared + parts[0], "short", "", None, "é" * 150, "é" * 150 + "a"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = run_index.brute_force(texts)
    for wide in (1, 10):
        got = {r["doc_id"]: tuple(r)[1:5] for r in run_index.exact_dedup(d, wide=wide).collect()}
        assert [got[i] for i in range(len(texts))] == want, wide


def test_decontamination_in_blocks(docs, bench):
    one = decontaminate.decontaminate(docs, bench)
    many = decontaminate.decontaminate(docs, bench, block_words=20)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    items = [(1, LONG), (2, "short")]
    assert {(r["doc_id"], r["n_hit"]) for r in one.collect()} == {x[:1] + x[2:3] for x in decontaminate.brute_force(ROWS, items)}


def test_items_without_an_id_hit_and_spans_of_blocks_are_one(spark):
    items = [(None, LONG), (None, "short"), (4, "short"), (None, None), (5, NEAR)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter(decontaminate.brute_force(ROWS, items))
    spans = []
    for words in (decontaminate.BLOCK_WORDS, 20):
        got = decontaminate.decontaminate(frame(spark), bench, block_words=words).collect()
        assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == want
        spans.append(Counter((r["doc_id"], tuple((x["start"], x["stop"]) for x in r["spans"])) for r in got))
        assert {r["doc_id"]: r["items"] for r in got}[7] == ["4", None]
    assert spans[0] == spans[1] and spans[0][1, ((0, len(LONG)),)] == 1
    kept = [r["doc_id"] for r in decontaminate.keep_clean(frame(spark), bench.filter("item_id IS NULL")).collect()]
    assert 7 not in kept and 1 not in kept and 8 in kept


def test_mix_meets_its_targets(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randint(0, 40)), "en", None if i % 9 == 0 else f"s{i % 5}", *[None] * 12) for i in range(300)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(d).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(d.repartition(7)).collect()))
    assert all(x["taken"] <= 2 * x["size"] for x in got)
    source, total = {x[0]: x[3] for x in rows}, sum(x["size"] for x in got)
    names = sorted({s for s in source.values() if s}) + [None]
    sizes = {s: sum(x["size"] for x in got if source[x["doc_id"]] == s) for s in names}
    share, open_ = {}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left = 1.5 * total
    while open_:
        level = left / sum(open_.values())
        over = [s for s, w in open_.items() if level * w > 2 * sizes[s]]
        for s in over or list(open_):
            share[s] = 2.0 * sizes[s] if over else level * open_[s]
            left -= share[s]
            open_.pop(s)
    for s in names:
        mine = [x for x in got if source[x["doc_id"]] == s]
        assert mine[0]["target"] == pytest.approx(share[s]) and mine[0]["source_size"] == sizes[s]
        assert abs(sum(x["taken"] for x in mine) - share[s]) <= 1


def test_schedule_is_spread_out(spark):
    s = spark.createDataFrame([(0, 500), (1, 300), (2, 1)], "key long, n_slots long")
    slots = mixing.schedule(s).orderBy("slot").collect()
    assert [r["slot"] for r in slots] == list(range(801))
    for key, n in ((0, 500), (1, 300), (2, 1)):
        assert [r["rank"] for r in slots if r["key"] == key] == list(range(n))
        for at in range(0, 801, 40):
            assert abs(sum(r["key"] == key for r in slots[:at]) - at * n / 801) <= 3


def test_near_duplicates(docs, spark):
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicate_classes(docs).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[9] == 9 and got[4] == 4 and got[5] == 5 and got[7] == 7
    kept = order_minhash.keep_representatives(docs)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [1, 4, 5, 6, 7, 8, 9] and kept.columns == docs.columns


def test_components(spark):
    r = random.Random(3)
    pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x["node"]: x["class"] for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for a, b in pairs if a != b for n in (a, b)}


def test_lines(spark):
    d = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "a\nb"), (4, None), (5, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["n_spans"], r["text"]) for r in lines.line_dedup(d).collect()}
    assert got == {1: (4, 0, 0, "a\nb\nc\nd"), 2: (6, 4, 1, "x\ny"), 3: (2, 0, 0, "a\nb"), 4: (0, 0, 0, None), 5: (1, 0, 0, "")}


def test_later_copies_lose_their_lines(spark):
    text, two = "a\nb\nc\nd", "a\nb"
    rows = [(None, text)] * 3000 + [(None, "q\nb\nc\nd")] + [(1, text)] * 3 + [(2, two)] * 2 + [(3, None)] * 2 + [(4, "z\nz\nz\nz")] * 2
    got = Counter((r["doc_id"], r["n_removed"], r["n_spans"], r["text"]) for r in lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    tail = {k: got.pop(k) for k in list(got) if k[0] is None}
    # Of the two texts without an id the one of the lower hash comes first and stays whole.
    assert sum(tail.values()) == 3001 and tail[None, 4, 1, ""] == 2999
    assert tail in ({(None, 4, 1, ""): 2999, (None, 0, 0, text): 1, (None, 3, 1, "q"): 1}, {(None, 4, 1, ""): 2999, (None, 3, 1, "a"): 1, (None, 0, 0, "q\nb\nc\nd"): 1})
    assert got == {(1, 4, 1, ""): 3, (2, 0, 0, two): 2, (3, 0, 0, None): 2, (4, 3, 1, "z"): 1, (4, 4, 1, ""): 1}


def test_pages(spark):
    p = spark.createDataFrame([(1, "http://a.net/x", "<p>Hi"), (2, None, None), (2, None, None), (None, "", "")], "page_id long, url string, html string")
    assert [r["text"] for r in html_text.extract_main_text(p).orderBy("page_id").collect()] == ["", "Hi", "", ""]
    got = url_filter.filter_urls(p).orderBy("page_id").collect()
    assert [(r["host"], r["rule"], r["verdict"]) for r in got] == [("", None, "allow"), ("a.net", "net/", "block"), ("", None, "allow"), ("", None, "allow")]
    assert url_filter.filter_urls(p.limit(0)).count() == 0 and html_text.extract_main_text(p.limit(0)).count() == 0


def slow_urls(rows):
    """Host, path, rule, verdict and score by plain dictionaries: the segments by trying all splits."""
    import math
    import re

    words = Counter(w for _, _, h in rows for w in re.findall("[a-z]+", re.sub(r"<[^>]*>", " ", h or "").lower()))
    for w in url_filter.SEED_BLOCK:
        words[w] = max(words[w], url_filter.SEED_WEIGHT)
    total = sum(words.values()) + len(words) + 1
    cost = lambda w: -math.log((words[w] + 1) / total) if w in words else math.log(total) + url_filter.UNKNOWN_LETTER * len(w)
    every = lambda t: [[t[:i], *rest] for i in range(1, len(t) + 1) for rest in every(t[i:])] if t else [[]]
    split = lambda t: min(every(t), key=lambda x: sum(map(cost, x)))
    out, counts = [], {"block": Counter(), "allow": Counter()}
    for i, url, _ in rows:
        rest = re.split("[?#]", (url or "").partition("://")[2])[0] if "://" in (url or "") else ""
        host, slash, path = rest.partition("/")
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path
        fits = [(r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, None))
        tokens = []
        for tag, text in (("h:", " ".join(x for x in re.findall("[a-z0-9]+", host) if x not in url_filter.PLAIN_LABELS)), ("p:", path.lower())):
            for run in re.findall("[a-z]+|[0-9]+", text):
                tokens += [tag + x for x in (["0"] if run[0].isdigit() else split(run))]
        if verdict:
            counts[verdict].update(tokens)
        out.append((i, host, path, rule, verdict, tokens))
    counts["block"].update({f"h:{w}": url_filter.SEED_WEIGHT for w in url_filter.SEED_BLOCK})
    names = counts["block"].keys() | counts["allow"].keys()
    sums = {k: sum(c.values()) + len(names) + 1 for k, c in counts.items()}
    weight = {t: round((math.log((counts["block"][t] + 1) / sums["block"]) - math.log((counts["allow"][t] + 1) / sums["allow"])) * url_filter.SCALE) for t in names}
    for i, host, path, rule, verdict, tokens in out:
        score = sum(weight.get(t, 0) for t in tokens)
        yield i, host, path, rule, verdict or ("block" if score > 0 else "allow"), score


def test_urls_match_brute_force(spark):
    r = random.Random(12)
    parts = ["news", "paper", "casino", "win", "blog", "the", "x", "42"]
    hosts = ["".join(r.choice(parts) for _ in range(r.randint(1, 2))) + r.choice([".net", ".example.net", ".example.com", ".org", ".de", ""]) for _ in range(60)]
    rows = [(i if i % 7 else None, f"http://{h.upper() if i % 5 == 0 else h}{r.choice(['', '/', '/en/', '/de/', '/fr/'])}{r.choice(parts)}{r.choice(['', '?q=/en/', '#a'])}", f"<p>{' '.join(r.choice(parts[:-1]) for _ in range(9))}</p>") for i, h in enumerate(hosts)]
    rows += [(100, None, None), (100, None, None), (101, "no scheme/casino", ""), (102, "://", "<b>the"), (103, "x://" + "news" * 3 + "/" + "q" * 9, None)]
    d = spark.createDataFrame([(*x, None, None, None) for x in rows], "page_id long, url string, html string, host string, row_a long, piece long")
    got = Counter((x["page_id"], x["host"], x["path"], x["rule"], x["verdict"], round(x["score"] * url_filter.SCALE)) for x in url_filter.filter_urls(d).collect())
    assert got == Counter(slow_urls(rows))
    long = spark.createDataFrame([(1, "http://a.de/" + "casino" * 2000, "")], "page_id long, url string, html string")
    assert url_filter.filter_urls(long).first()["path"] == "/" + "casino" * 2000


def test_tokens_round_trip(spark, docs):
    code = tokens.encoder(tokens.tokenizer_file())
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for d, t in order:
        n = len(code.whole(t or "")) // code.width + 1
        want.append((d, start, n))
        start += n
    assert sorted((tuple(r)[:3] for r in tokens.token_output(docs).collect()), key=lambda r: r[1]) == want


def test_tokens_of_one_id_are_dealt_to_several_files(spark):
    rows = [(None, f"text {i % 40} of no document") for i in range(400)] + [(i, "x") for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts stay apart
    try:
        files = tokens.write_token_files(d, tokens.shared_path(spark, "tokens"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert files.count() > 3 and files.agg(F.max("n_docs")).first()[0] < 300
    got = tokens.token_output(d).collect()
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == [None] * 400 + list(range(5)) and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ordered, ordered[1:], strict=False))
    assert Counter((r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((r["n_tokens"], r["ids_crc32"]) for r in tokens.token_output(d.repartition(3)).collect())


def test_toxicity_learns(spark):
    r = random.Random(7)
    rows = [(i, " ".join(["vilword" if i % 4 == 0 and k % 6 == 0 else f"w{r.randrange(200)}" for k in range(30)])) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score_toxicity(d, d.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))).collect()
    assert all(x["predicted"] == (x["doc_id"] % 4 == 0) for x in got) and 0 < sum(x["held_out"] for x in got) < 200


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_matches_sql(spark, name):
    assert compare(spark, name, queries.QUERIES[name], queries.ORACLE[name], SF) == ""


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = c.table(spark, SF, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    bench = [(r["item_id"], r["text"]) for r in c.table(spark, SF, "benchmark").collect()]
    out = c.written(c.quality_stage(spark, docs, SF), "t")
    good = {i for i, t in rows.items() if (b := quality.brute_force(t))[0] >= 10 and 5 * b[1] <= b[0] and b[2] <= 0.15 * b[0] and b[3] <= 60}
    assert {r["doc_id"] for r in out.collect()} == good and out.columns == docs.columns
    near = c.written(c.near_duplicate_stage(spark, out, SF), "t")
    kept = {r["doc_id"] for r in near.collect()}
    labels = {i: order_minhash.shingle_labels(*order_minhash.word_hashes([rows[i]]))[0] for i in good}
    for i in good - kept:
        assert any(order_minhash.aligned_similarity(labels[i], labels[j]) >= 0.8 - 1e-12 for j in good if j != i)
    for i in kept:
        assert not any(order_minhash.aligned_similarity(labels[i], labels[j]) >= 0.8 - 1e-12 for j in kept if j < i)
    clean = c.written(c.decontamination_stage(spark, near, SF), "t")
    assert {r["doc_id"] for r in clean.collect()} == {x[0] for x in decontaminate.brute_force([(i, rows[i]) for i in sorted(kept)], bench) if not x[5]}
    mixed = c.written(c.mixture_stage(spark, clean, SF), "t")
    assert mixed.columns == docs.columns and max(Counter(r["doc_id"] for r in mixed.collect()).values()) <= 2
    last = c.token_stage(spark, mixed, SF).collect()
    assert Counter(r["doc_id"] for r in last) == Counter(r["doc_id"] for r in mixed.collect())


def family(n, words=120, most=14, seed=5):
    """Copies of one text with separate edits, and their classes by comparing all pairs."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        at = r.randrange(words)
        for k in range(r.randrange(most)):
            w[(at + k * 3) % words] = f"e{i}x{k}" if r.random() < 0.6 else f"s{r.randrange(6)}"
        rows.append((i, " ".join(w)))
    labels = [order_minhash.shingle_labels(*order_minhash.word_hashes([t]))[0] for _, t in rows]
    of = list(range(n))
    for a in range(n):
        for b in range(a):
            if of[a] != of[b] and order_minhash.aligned_similarity(labels[a], labels[b]) >= 0.8 - 1e-12:
                low, high = sorted((of[a], of[b]))
                of = [low if x == high else x for x in of]
    return rows, labels, of


def test_near_duplicate_classes_are_whole(spark):
    rows, _, want = family(250)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), max_rounds=1).collect()}
    assert [got[i] for i in range(250)] == want and 1 < len(set(want)) < 250


def test_no_pair_of_a_hot_label_is_missed(spark, monkeypatch):
    rows, labels, _ = family(120)
    monkeypatch.setattr(order_minhash, "BLOCK", 16)
    docs = order_minhash.keyed(spark.createDataFrame(rows, "doc_id long, text string"))
    common, counts = order_minhash.common_labels(docs)
    nodes = order_minhash.features(docs, common, counts).withColumnsRenamed({"doc_id": "node", "n_shingles": "n"}).withColumn("group", F.col("node"))
    hot = order_minhash.hot_labels(nodes.select(F.explode("prefix").alias("label")))
    assert hot.count() > 3
    got = {tuple(r) for r in order_minhash.rest_of_pairs(nodes).collect()}
    want = {(b, a) for a in range(120) for b in range(a) if order_minhash.aligned_similarity(labels[a], labels[b]) >= 0.8 - 1e-12}
    assert want and want <= got
    # Labels that the sketch of frequent ones doesn't name are dealt as well.
    monkeypatch.setattr(order_minhash, "hot_labels", lambda rows: spark.createDataFrame([], "label long"))
    assert {tuple(r) for r in order_minhash.rest_of_pairs(nodes).collect()} == got
    # Texts of one class don't meet.
    assert order_minhash.rest_of_pairs(nodes.withColumn("group", F.lit(1))).isEmpty()


def test_sizes_of_neighbouring_bands_meet(spark, monkeypatch):
    """One word more for each text: all share their labels, and those of up to 1.25 times the size link."""
    monkeypatch.setattr(order_minhash, "BLOCK", 8)
    texts = [" ".join(f"w{j}" for j in range(5 + 2 * i)) for i in range(60)]
    labels = [order_minhash.shingle_labels(*order_minhash.word_hashes([t]))[0] for t in texts]
    docs = order_minhash.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    nodes = order_minhash.features(docs, *order_minhash.common_labels(docs)).withColumnsRenamed({"doc_id": "node", "n_shingles": "n"}).withColumn("group", F.col("node"))
    got = {tuple(r) for r in order_minhash.rest_of_pairs(nodes).collect()}
    want = {(b, a) for a in range(60) for b in range(a) if order_minhash.aligned_similarity(labels[a], labels[b]) >= 0.8 - 1e-12}
    assert want and want <= got


def test_classes_without_sketch_rounds(spark):
    rows, _, want = family(60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicate_classes(docs, max_rounds=0).collect()}
    assert [got[i] for i in range(60)] == want


def test_near_duplicates_go_by_text_not_by_id(spark):
    other = " ".join(f"quite{i}" for i in range(50))
    d = frame(spark, [(None, LONG), (None, other), (1, LONG), (1, NEAR), (2, other), (2, other), (2, "one of its own here"), (None, "no id at all"), (3, None), (3, None), (None, "")])
    got = Counter(tuple(r) for r in order_minhash.near_duplicate_classes(d).collect())
    one = {k[0]: k for k in got if k[0] == 1 and k[2]}
    assert len(one) == 1 and sum(n for k, n in got.items() if k[1] == 1) == 3 and sum(n for k, n in got.items() if k[1] == 2 and k[0] is None) == 1
    assert got[2, 2, True] == 3 and got[None, 2, False] == 1 and got[None, None, True] == 2 and got[3, 3, True] == 2 and sum(got.values()) == 11
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in order_minhash.keep_representatives(d).collect())
    assert kept in ([(0, ""), (0, "no id at all"), (1, x), (2, "one of its own here"), (2, other), (3, ""), (3, "")] for x in (LONG, NEAR))


STAGE_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _times int, _slot long, _row_file string, _ROW_PLACE int, _k1 long, _K2 string, row_a long, key long, taken long, rep long, node long"
OTHER = " ".join(f"other{i}" for i in range(40))
THIRD = " ".join(f"third{i}" for i in range(30))
BAD = " ".join(f"bench{i}" for i in range(20))


def staged(spark, rows):
    return spark.createDataFrame([(d, t, "en", s, None, *[None] * 11) for d, t, s in rows], STAGE_SCHEMA)


def test_stages_are_true_to_rows(spark, tmp_path):
    import corpus_pipeline as c

    sf = str(tmp_path)
    spark.createDataFrame([(1, BAD), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    rows = [(None, LONG, "a"), (None, OTHER, "a"), (None, BAD, None), (1, LONG, "a"), (1, THIRD, "b"), (1, THIRD, "b"), (2, BAD + " tail", "b"), (2, OTHER + " more", "a"), (3, None, "a"), (3, "", None), (4, "few words", "b")]
    d = staged(spark, rows)
    texts = lambda df: sorted((r["doc_id"] or 0, r["text"] or "") for r in df.collect())
    good = c.quality_stage(spark, d, sf)
    assert texts(good) == sorted((i or 0, t) for i, t, _ in rows if t and len(t) > 20) and good.columns == d.columns
    near = c.near_duplicate_stage(spark, good, sf)
    # One of each class, the one of the lowest id: LONG, THIRD, OTHER with its longer form, BAD with its longer form.
    assert texts(near) == sorted([(1, LONG), (1, THIRD), (2, OTHER + " more"), (2, BAD + " tail")]) and near.columns == d.columns
    clean = c.decontamination_stage(spark, good, sf)
    assert texts(clean) == sorted((i or 0, t) for i, t, _ in rows if t and len(t) > 20 and not t.startswith("bench")) and clean.columns == d.columns
    mixed = c.mixture_stage(spark, d, sf)
    taken = Counter(texts(mixed))
    once = Counter(texts(d))
    assert mixed.columns == d.columns and all(n <= 2 * once[k] for k, n in taken.items())
    # Source a (weight 5) and b (2) and null (1): 150 % of all words, none above twice its own.
    want = {(r["doc_id"] or 0, r["size"]): 0 for r in mixing.mix(d).collect()}
    for r in mixing.mix(d).collect():
        want[r["doc_id"] or 0, r["size"]] += 0 if not r["taken"] else 1 + (r["taken"] > r["size"])
    got = Counter((i, len(t.split())) for i, t in texts(mixed))
    assert {k: n for k, n in want.items() if n} == dict(got)
    last = c.token_stage(spark, mixed, sf)
    assert Counter(r["doc_id"] or 0 for r in last.collect()) == Counter(i for i, _ in texts(mixed))
    empty = d.limit(0)
    for name, stage in c.STAGES:
        assert stage(spark, empty, sf).count() == 0, name


def test_keep_clean_judges_each_row_in_blocks_too(spark, bench):
    d = frame(spark, [(None, LONG), (1, LONG), (1, "quite another text"), (None, "clean")])
    want = [("clean",), ("quite another text",)]
    for limit in (decontaminate.BLOCK_WORDS, 20):
        got = decontaminate.keep_clean(d, bench, block_words=limit)
        assert sorted(tuple(r) for r in got.select("text").collect()) == want and got.columns == d.columns
