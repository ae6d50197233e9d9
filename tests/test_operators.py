"""Literal cases of the curation and evaluation operators."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from oriel.functions import expressions as X
from oriel.functions import geometry as G
from oriel.functions import hashing as H
from oriel.operators import dedup as D
from oriel.operators import metrics as M
from oriel.operators import pairing as P
from oriel.operators import review as R
from oriel.operators import select as S
from oriel.operators import validate as V


def one(df):
    return df.first().asDict()


def test_presence_nulls(spark):
    d = spark.createDataFrame([(False, False)] * 3, "t boolean, p boolean")
    r = one(M.presence_metrics(d, "t", "p"))
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (None, None, None, 1.0)
    d = spark.createDataFrame([(True, False), (False, True)], "t boolean, p boolean")
    assert one(M.presence_metrics(d, "t", "p"))["f1"] == 0.0


def test_presence_known_figures(spark):
    rows = [(True, True)] * 9 + [(False, True)] * 3 + [(True, False)] * 2 + [(False, False)] * 3
    r = one(M.presence_metrics(spark.createDataFrame(rows, "t boolean, p boolean"), "t", "p"))
    assert [round(r[k], 4) for k in ("accuracy", "precision", "recall", "f1")] == [0.7059, 0.75, 0.8182, 0.7826]


def test_no_rows_is_an_error(spark):
    with pytest.raises(Exception, match="no evaluated rows"):
        M.presence_metrics(spark.createDataFrame([], "t boolean, p boolean"), "t", "p").collect()


def test_failed_prediction_is_no_negative(spark):
    r = one(M.presence_with_fpr(spark.createDataFrame([(True, None), (True, True)], "t boolean, p boolean"), "t", "p"))
    assert (r["tp"], r["fn"], r["false_positive_rate"]) == (1, 0, None)


def test_percentile_interpolates(spark):
    d = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double")
    assert one(M.timing_summary(d, "v"))["p95_ms"] == pytest.approx(3.85)


def test_split_is_the_hash(spark):
    d = spark.createDataFrame([(f"l{i}", f"s{i % 7}") for i in range(200)], "a string, b string")
    for r in d.select("a", "b", H.assigned_split(42, "a", "b").alias("s")).collect():
        n = int.from_bytes(hashlib.sha256(f"42:{r['a']}:{r['b']}".encode()).digest()[:8], "big") % 100
        assert r["s"] == ("train" if n < 70 else "validation" if n < 85 else "test")


def test_best_threshold_ties(spark):
    rows = [(0.05, 0.9, 0.5, 0.2), (0.10, 0.9, 0.5, 0.2), (0.15, 0.8, 0.9, 0.0), (0.2, None, None, None)]
    d = spark.createDataFrame(rows, "threshold double, recall double, mean_iou double, false_positive_rate double")
    assert one(S.best_threshold(d))["threshold"] == 0.05


def walk(items, budget, most):
    out, used = [], 0
    for k, s in sorted(items):
        if len(out) < most and used + s <= budget:
            out.append(k)
            used += s
    return out


@pytest.mark.parametrize("budget,most", [(100, 5), (37, 50), (10, 3), (1, 2), (500, 4)])
def test_budget_select(spark, budget, most):
    items = [(hashlib.md5(str(i).encode()).hexdigest(), (i * 37) % 23 + 1) for i in range(60)]
    got = S.budget_select(spark.createDataFrame(items[::-1], "k string, s int"), "k", "s", budget, most)
    assert [r["k"] for r in got.orderBy("take").collect()] == walk(items, budget, most)


def test_holdout_and_ratio(spark):
    d = spark.range(1, 26).withColumnRenamed("id", "rank")
    parts = S.holdout_head(d).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in parts} == {"validation": 2, "train": 23}  # round(2.5) to even
    with pytest.raises(Exception, match="no training rows"):
        S.holdout_head(spark.range(1, 2).withColumnRenamed("id", "rank")).collect()
    mix = S.ratio_mix(spark.range(10), spark.createDataFrame([(1, "x")], "rank long, n string"), 4, "n").orderBy("place").collect()
    assert [r["target_name"] for r in mix] == ["0000_x", "0001_x"]
    with pytest.raises(ValueError):
        S.ratio_mix(d, d, 3, "rank")


def test_greedy_keep_matches_a_fold(spark):
    hashes = [(i * 2654435761 % 2**31) & 0xFF for i in range(150)]
    kept = []
    for h in hashes:
        kept.append(h if all((h ^ k).bit_count() > 2 for k in kept if k is not None) else None)
    got = D.greedy_keep(spark.createDataFrame(list(enumerate(hashes)), "rank long, hash long"), 2)
    assert {r["rank"] for r in got.filter("kept").collect()} == {i for i, k in enumerate(kept) if k is not None}


@pytest.mark.parametrize("agree", [1, 2, 3])
def test_first_near_matches_brute_force(spark, agree):
    hashes = [(i * 0x9E3779B97F4A7C15 % 2**64) >> 44 for i in range(300)]
    got = {r["idx"]: (r["match_idx"], r["distance"]) for r in D.first_near(spark.createDataFrame(list(enumerate(hashes)), "idx long, hash long"), 5, agree).collect()}
    for i, h in enumerate(hashes):
        want = next(((j, (h ^ g).bit_count()) for j, g in enumerate(hashes[:i]) if (h ^ g).bit_count() <= 5), (None, None))
        assert got[i] == want


def test_leak_modes(spark):
    rows = [(0, 0, "train"), (1, 1, "train"), (2, 3, "test"), (3, 2, "train")]
    d = spark.createDataFrame(rows, "idx long, hash long, split string")
    every = {(r["idx"], r["match_idx"]) for r in D.split_leaks(d, 1, "all_pairs").collect()}
    first = {(r["idx"], r["match_idx"]) for r in D.split_leaks(d, 1, "first_match").collect()}
    assert every == {(2, 1), (3, 2)} and first == {(2, 1)}


def test_pairing(spark):
    d = spark.createDataFrame([(1, "image", "a"), (1, "label", "b"), (2, "image", "c"), (3, "label", "d"), (3, "label", "e")], "k int, role string, v string")
    got = {r["k"]: r["status"] for r in P.paired_roles(d, "k", "role", "v", ["image", "label"]).collect()}
    assert got == {1: "paired", 2: "unpaired", 3: "duplicate"}


def test_paths_and_names(spark):
    d = spark.createDataFrame([("a/b.jpg",), ("/a",), ("a/../b",), ("a\\b",), ("",), (None,), ("./a//b",)], "p string")
    assert [r[0] for r in d.select(X.is_safe_path("p")).collect()] == [True, False, False, False, False, False, True]
    d = spark.createDataFrame([("C:\\x\\Foto 1.JPG",), (".hidden",)], "p string")
    assert [tuple(r) for r in d.select(X.base_name("p"), X.stem("p"), X.suffix("p")).collect()] == [("Foto 1.JPG", "Foto 1", ".jpg"), (".hidden", ".hidden", "")]


def test_times_need_zones(spark):
    d = spark.createDataFrame([("2024-05-01T10:00:00Z",), ("2024-05-01T10:00:00",), ("2024-05-01T10:00:00+07:00",), ("soon",), (None,)], "t string")
    assert [r[0] for r in d.select(X.is_zoned_timestamp("t")).collect()] == [True, False, True, False, False]


def test_geometry(spark):
    d = spark.createDataFrame([([0, 1, 1], [0, 0, 0]), ([0, 0, 0], [0, 0, 0]), ([1, 1, 0], [1, 0, 0])], "a array<int>, b array<int>")
    assert [r[0] for r in d.select(G.binary_iou("a", "b")).collect()] == [0.0, 1.0, 0.5]
    with pytest.raises(Exception, match="shapes differ"):
        spark.createDataFrame([([0], [0, 1])], "a array<int>, b array<int>").select(G.binary_iou("a", "b")).collect()
    square = "array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 4D), named_struct('x', 0D, 'y', 4D))"
    row = spark.range(1).select(F.expr(square).alias("p")).select(G.shoelace_area("p"), G.polygon_error("p", F.lit(4), F.lit(4)), G.polygon_error("p", F.lit(3), F.lit(4))).first()
    assert tuple(row) == (16.0, None, "outside")


def test_review_flow(spark):
    m = R.seeded(spark.createDataFrame([("a",), ("b",), ("c",)], "sample_id string"), ["tactile_present"])
    m = R.imported(m, spark.createDataFrame([("a", "1"), ("b", "0")], "sample_id string, tactile_present string"), "sample_id", "tactile_present")
    m = R.mark_human_reviewed(m, spark.createDataFrame([("a",)], "sample_id string"), "sample_id", "me", "2024-01-01T00:00:00Z")
    m = R.mark_ambiguous(m, spark.createDataFrame([("b",)], "sample_id string"), "sample_id", "blurred")
    assert {r["sample_id"]: r["review_status"] for r in m.collect()} == {"a": "human_reviewed", "b": "ambiguous", "c": "unreviewed"}
    assert [r["e"] for r in m.orderBy("sample_id").select(V.all_errors(R.review_errors()).alias("e")).collect()] == [[], [], []]
    with pytest.raises(Exception, match="only provisional"):
        R.mark_ambiguous(m, spark.createDataFrame([("c",)], "sample_id string"), "sample_id", "why").collect()


def test_gates_fail_closed(spark):
    d = spark.createDataFrame([(0.9, 0.75), (1.0, None), (0.89, 0.9)], "r double, i double")
    assert [r[0] for r in d.select(V.deployment_gate("r", "i")).collect()] == [True, False, False]
    d = spark.createDataFrame([("obstacle", False), ("uncertain", None), ("clear", False)], "s string, f boolean")
    assert [r[0] for r in d.select(V.combined_status("s", "f")).collect()] == ["obstacle", "failure", "failure"]


def test_require(spark):
    d = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="duplicate key"):
        V.require_unique(d, "k").collect()
    with pytest.raises(Exception, match="must be two"):
        V.require(d, F.col("k") == 2, "must be two").collect()


def family(r, n, spread=3):
    """A third of all hashes in one family, and some chains."""
    centre, hashes = r.getrandbits(64), []
    for i in range(n):
        if i % 3 == 0:
            h = centre
            for _ in range(r.randint(0, spread)):
                h ^= 1 << r.randrange(64)
        elif i % 3 == 1 and hashes:
            h = hashes[-1] % (1 << 64) ^ 1 << r.randrange(64) ^ 1 << r.randrange(64)
        else:
            h = r.getrandbits(64)
        hashes.append(h - (1 << 64) if h >> 63 else h)
    return hashes


def bits(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


@pytest.mark.parametrize("threshold", [0, 1, 3, 5, 8])
def test_half_keys_find_all_near_hashes(spark, threshold):
    r = random.Random(threshold)
    hashes = family(r, 60, threshold)
    d = spark.createDataFrame([(h,) for h in hashes], "hash long")
    keys = {x["hash"]: x["k"] for x in d.select("hash", D.half_keys("hash", threshold).alias("k")).collect()}
    assert max(map(len, keys.values())) <= 30
    for a in hashes:
        for b in hashes:
            if bits(a, b) <= threshold:
                assert set(keys[a]) & set(keys[b])


@pytest.mark.parametrize("one_cut", [0, 1000])
def test_rising_ranges_and_greedy_ranges_match_brute_force(spark, monkeypatch, one_cut):
    monkeypatch.setattr(D, "ONE_CUT", one_cut)
    monkeypatch.setattr(D, "FIRST_RANGE", 6)
    monkeypatch.setattr(D, "GROWTH", 5)
    monkeypatch.setattr(D, "HEAD", 30)
    r = random.Random(11)
    hashes = family(r, 150)
    rows = [(i, h, r.choice("abc")) for i, h in enumerate(hashes)]
    d = spark.createDataFrame(rows, "idx long, hash long, split string").repartition(3).cache()
    first = {i: next((j for j in range(i) if bits(hashes[i], hashes[j]) <= 5), None) for i in range(150)}
    got = {x["idx"]: (x["match_idx"], x["distance"]) for x in D.first_near(d, 5).collect()}
    assert got == {i: (j, None if j is None else bits(hashes[i], hashes[j])) for i, j in first.items()}
    other = {i: next((j for j in range(i) if rows[j][2] != rows[i][2] and bits(hashes[i], hashes[j]) <= 5), None) for i in range(150)}
    got = {x["idx"]: (x["match_idx"], x["match_split"]) for x in D.split_leaks(d, 5, "all_pairs").collect()}
    assert got == {i: (j, rows[j][2]) for i, j in other.items() if j is not None}
    kept = []
    for i in range(150):
        if all(bits(hashes[i], hashes[k]) > 5 for k in kept):
            kept.append(i)
    for fold in (D.FOLD_PAIRS,) if one_cut else (4,):
        monkeypatch.setattr(D, "FOLD_PAIRS", fold)
        out = D.greedy_keep(d.withColumnRenamed("idx", "rank"), 5).collect()
        assert sorted(x["rank"] for x in out if x["kept"]) == kept and len(out) == 150


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    h, chain = 0, []
    for i in range(3000):
        h ^= 0b111 << (3 * (i % 21))  # within 5 bits of the one before only
        chain.append((i, h - (1 << 64) if h >> 63 else h))
    made = []
    real = D.written
    monkeypatch.setattr(D, "written", lambda df, name: made.append(name) or real(df, name))
    d = spark.createDataFrame(chain, "rank long, hash long")
    kept = []
    for i, x in chain:
        if all(bits(x, chain[k][1]) > 5 for k in kept):
            kept.append(i)
    assert sorted(x["rank"] for x in D.greedy_keep(d, 5).collect() if x["kept"]) == kept
    assert len(made) <= 10


@pytest.mark.parametrize("limit", [None, 4])
def test_subset_reasons_in_order(spark, limit):
    r = random.Random(21)
    hashes = [r.getrandbits(60) for _ in range(12)]
    near = lambda h: h ^ 0b101
    row = lambda i, key, h, paired=True, valid=True: (i, key, h, paired, valid)
    public = [
        row(1, "a", hashes[0], False), row(2, "a", hashes[0], None), row(3, "b", hashes[1], True, None), row(4, "p", hashes[2]), row(5, "s", hashes[3]),
        row(6, "c", hashes[4]), row(7, "c", hashes[4]), row(8, "d", near(hashes[2])), row(9, "e", near(hashes[3])), row(10, "f", near(hashes[4])), row(11, "f", near(hashes[4])),
        row(12, "g", hashes[5]), row(13, None, hashes[6]), row(14, None, hashes[6]), row(15, None, None), row(16, "h", hashes[7]), row(17, "d", near(hashes[2])), row(18, "g", hashes[5]),
    ]
    want = {1: "unpaired", 2: "unpaired", 3: "invalid_pair", 4: "protected_exact", 5: "station_exact", 6: "retained", 7: "public_exact", 8: "protected_near", 9: "station_near", 10: "public_near", 11: "public_near",
            12: "retained", 13: "retained", 14: "public_near", 15: "retained", 16: "retained", 17: "protected_near", 18: "public_exact"}
    if limit:
        want = {k: v if k <= 15 else None for k, v in want.items()}
    d = spark.createDataFrame(public, "rank long, key string, hash long, paired boolean, valid boolean").repartition(3)
    sets = [spark.createDataFrame([(k, h), (None, None)], "key string, hash long") for k, h in (("p", hashes[2]), ("s", hashes[3]))]
    assert {x["rank"]: x["reason"] for x in D.subset_reasons(d, *sets, 5, limit).collect()} == want


@pytest.mark.parametrize("bins, few", [(4096, 0), (3, 0), (1, 0), (4096, 1 << 20)])
def test_exact_percentiles_equal_the_built_in(spark, monkeypatch, bins, few):
    r = random.Random(2)
    rows = [(r.choice(["a", "b", None]), r.choice([float(r.randint(-4, 4)), r.gauss(0, 1), 1e9 * r.random(), None])) for _ in range(400)] + [("c", 5.0), ("d", None), ("e", 2.0), ("e", 2.0)]
    d = spark.createDataFrame(rows, "k string, v double").repartition(3)
    names = {"low": 0.0, "p33": 0.33, "p50": 0.5, "p95": 0.95, "top": 1.0}
    plain = lambda df: sorted(map(str, df.collect()))
    monkeypatch.setattr(M, "FEW_ROWS", few)
    assert plain(M.exact_percentiles(d, ["k"], "v", names, bins)) == plain(d.groupBy("k").agg(*M.percentiles("v", names)))
    assert plain(M.exact_percentiles(d, [], "v", names, bins)) == plain(d.agg(*M.percentiles("v", names)))
    assert plain(M.exact_percentiles(d.limit(0), [], "v", names)) == plain(d.limit(0).agg(*M.percentiles("v", names)))


@pytest.mark.parametrize("budget, most", [(900, 1000), (900, 7), (0, 5), (10**6, 1000), (250, 30)])
def test_budget_walk_over_blocks(spark, budget, most):
    r = random.Random(budget + most)
    rows = [(f"{i:04d}", r.choice([0, 1, 3, 20, 90, 400, None])) for i in range(200)]
    left, want = budget, []
    for k, n in rows:
        if n is not None and n <= left and len(want) < most:
            left -= n
            want.append((k, len(want) + 1))
    d = spark.createDataFrame(rows, "k string, n int").repartition(4)
    for block in (11, 100_000):
        got = S.budget_select(d, "k", "n", budget, most, block_rows=block).orderBy("take").collect()
        assert [(x["k"], x["take"]) for x in got] == want


def test_threshold_reports_sum_up_once(spark):
    r = random.Random(5)
    rows = [(r.choice([True, False, None]), r.choice([None, 0.1, 0.5, 0.7, 0.9]), r.choice([None, r.random()])) for _ in range(200)]
    d = spark.createDataFrame(rows, "t boolean, s double, i double")
    each = d.withColumn("threshold", F.explode(F.array(*map(F.lit, (0.3, 0.5, 0.8)))))
    hit = F.col("s") >= F.col("threshold")
    want = each.groupBy("threshold").agg(*M.confusion("t", hit), M.mean_iou("t", F.when(hit, F.col("i")).otherwise(F.lit(0.0))).alias("mean_iou")).collect()
    got = {x["threshold"]: x for x in M.threshold_reports(d, [0.5, 0.3, 0.8], "t", "s", "i").collect()}
    for w in want:
        assert all(got[w["threshold"]][c] == (pytest.approx(w[c]) if w[c] is not None else None) for c in w.asDict())
