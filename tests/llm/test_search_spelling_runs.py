"""Top-k search, spelling variants and periodic runs against brute force, and on odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oriel.llm import periodic, pivot_index, spelling

CLASH = ", a long, b long, pivot int, tile long, codes binary, word string, n long, bin long"
NONE = [None] * 8


def vectors(spark, rows):
    return spark.createDataFrame([(*r, *NONE) for r in rows], f"vec_id long, embedding array<float>{CLASH}")


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_top_k_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "ROWS_A_PIVOT", 40)
    monkeypatch.setattr(pivot_index, "BLOCK_ROWS", 32)
    r = np.random.default_rng(3)
    centres = r.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + r.normal(size=8) * 0.1).astype("f4").tolist()) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]  # a frequent vector
    assert found(pivot_index.top_k(vectors(spark, rows).repartition(5))) == sorted(pivot_index.brute_force(rows), key=repr)


def test_top_k_leaves_out_annuli(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "ROWS_A_PIVOT", 100)
    monkeypatch.setattr(pivot_index, "BLOCK_ROWS", 64)
    seen = []
    r = np.random.default_rng(4)
    centres = np.eye(10) * 8
    rows = [(i, (centres[i % 10] + r.normal(size=10) * 0.01).astype("f4").tolist()) for i in range(1000)]
    index = pivot_index.Index
    monkeypatch.setattr(pivot_index, "Index", lambda *a: seen.append(index(*a)) or seen[-1])
    assert found(pivot_index.top_k(vectors(spark, rows))) == sorted(pivot_index.brute_force(rows), key=repr)
    codes = np.floor(64 * np.array([v for _, v in rows])).astype("<i4")
    d = pivot_index.distances(pivot_index.raised(codes, seen[0].most_sq), seen[0].pivots)
    own = d.argmin(axis=1)
    q = pivot_index.raised(codes[:1], None)
    s = np.sort((codes[1:] @ codes[0]).astype(float))[-20]
    reach = np.sqrt((codes[0].astype(float) ** 2).sum() + seen[0].most_sq - 2 * s)
    dq = pivot_index.distances(q, seen[0].pivots)[0]
    near = abs(d[np.arange(1000), own] - dq[own]) <= reach
    assert near.sum() < 300  # far clusters lie outside of the bounds


@pytest.mark.parametrize("rows", [
    [],
    [(20, [1.0, 2.0])],
    [(0, None), (20, [1.0, None]), (40, [float("nan"), 1.0]), (60, [float("inf"), 1.0]), (80, [0.5, 0.5]), (100, [0.5, 0.5])],
    [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (None, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [])],
    [(20, [1.0]), (21, [1.0, 2.0, 3.0]), (-40, [-0.01, 0.0]), (7, [])],
    [(20, [1e30]), (40, [3e7, -3e7]), (60, [3e7, 3e7]), (61, [1.5, 2.5]), (80, [3000.0, 1.0]), (81, [40000.0, 5.0])],
])
def test_top_k_of_odd_rows(spark, rows):
    df = vectors(spark, rows) if rows else vectors(spark, [(1, [1.0])]).limit(0)
    got = found(pivot_index.top_k(df))
    assert got == sorted(pivot_index.brute_force(rows), key=repr)
    assert all(0 < r[1] <= 20 for r in got)


def made_texts(r, n):
    parts = ["an", "ber", "tion", "ô", "mi", "ra", "les", "ke", "Un", "ß"]
    words = ["".join(r.choice(parts) for _ in range(r.randint(2, 5))) for _ in range(60)]
    texts = []
    for _ in range(n):
        text = []
        for _ in range(r.randint(0, 40)):
            w = words[min(int(r.expovariate(0.1)), 59)]
            if r.random() < 0.3:
                i = r.randrange(len(w))
                w = r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("aeé") + w[i:], w[:i] + r.choice("aeX") + w[i + 1 :]])
            text.append(w)
        texts.append(r.choice([" ", "\n", "'", "1", "’"]).join(text))
    return texts


@pytest.mark.parametrize("shard", [spelling.SHARD, 5])
def test_spelling_matches_brute_force(spark, shard):
    r = random.Random(6)
    rows = [(i if i % 50 else None, t) for i, t in enumerate(made_texts(r, 500))] + [(7, None), (8, ""), (9, "abcdefg " * 4000), (9, "abcdefg " * 3)]
    rows += [(2001, "chaynworl " * 5 + "chaynword " * 30 + "chainword " * 200)]
    df = spark.createDataFrame([(*x, *NONE) for x in rows], f"doc_id long, text string{CLASH}").repartition(4)
    got = sorted(map(tuple, spelling.spelling_groups(df, shard=shard).collect()), key=repr)
    want = sorted(spelling.brute_force(rows), key=repr)
    assert got == want and any(x[1] for x in want) and any(x[2] not in (x[0], x[1]) for x in want)
    assert spelling.spelling_groups(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé", min_size=6, max_size=9), max_size=40, unique=True))
def test_halves_find_all_near_words(words):
    shards = {s: spelling.Halves([(s, w, i) for i, w in enumerate(words)]) for s in "LR"}

    def close(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    for w in words:
        left, right = shards["L"].near(w, "L"), shards["R"].near(w, "R")
        assert not left.keys() & right.keys()
        assert left | right == {v: i for i, v in enumerate(words) if close(v, w)}


def test_words_of_long_texts_are_whole(monkeypatch):
    text = " ".join(made_texts(random.Random(1), 60)) + "abcdefgh" * 50
    want = spelling.runs(text, 6)
    monkeypatch.setattr(spelling, "SLICE", 37)
    assert spelling.runs(text, 6) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=12), st.integers(0, 6), st.lists(st.integers(0, 2), max_size=9), st.integers(0, 6), st.lists(st.integers(0, 2), max_size=30))
def test_runs_match_brute_force(a, k, b, m, c):
    words = (a * k + b) * m + c + a * k
    want = periodic.brute_force(words)
    assert sorted(periodic.squares(words), key=lambda r: (r[0], r[2])) == want
    stretches = periodic.repeated_stretches(np.array(words)) if words else []
    assert all(any(x <= s and s + n <= y for x, y in stretches) for s, n, _ in want)


def test_end_positions_over_several_parts():
    ends, r = periodic.Ends(70_000), random.Random(2)
    known = {70_000}
    for x in r.sample(range(400_000), 300):
        if x not in known:
            ends.add(x)
            known.add(x)
    order = sorted(known)
    assert list(ends) == order and ends.size == len(order)
    for before, x, after in zip([-1, *order], order, [*order[1:], -1]):
        assert ends.neighbours(x) == (before, after)


def slow_row(doc, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    n = len(words)
    if doc is not None and n and zlib.crc32(str(doc).encode()) % 10 == 0:
        g = zlib.crc32(str(doc).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = periodic.brute_force(words)
    top = max(found, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    figures = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return doc, len(found), *figures, sha("".join(f"{s},{k},{q}\n" for s, k, q in found)), sha(kept), kept


def test_periodic_rows_match_brute_force(spark):
    r = random.Random(9)
    texts = [" ".join(r.choice(["a", "b", "é", "d"][: r.randint(1, 4)]) for _ in range(r.randint(0, 90))) for _ in range(150)]
    texts += ["x y z " * 40, "\n\t x  y\n" * 30, "a " * 23, "a " * 24, "a b " * 12, "", " ", None, "a " * 30_000]
    rows = [(i if i % 40 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame([(*x, *NONE) for x in rows], f"doc_id long, text string{CLASH}").repartition(3)
    want = [slow_row(d, t) if len(t or "") < 10_000 else (d, *periodic.digest(t, d)[:-1], periodic.digest(t, d)[-1].decode()) for d, t in rows]
    got = [tuple(x) for x in periodic.find_runs(df, with_text=True).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, periodic.find_runs(df).collect()), key=repr) == sorted((w[:-1] for w in want), key=repr)
    assert periodic.find_runs(df.limit(0)).count() == 0
