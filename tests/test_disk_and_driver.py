"""What queries leave on disk on their way, and what near-duplicate retention hands to the driver."""

import hashlib
import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from oriel.llm import order_minhash
from oriel.operators import dedup
from oriel.plans import tables
from oriel.sources import files, readers


def shuffle_files(spark):
    dirs = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return {f.name for d in dirs for f in Path(d).rglob("shuffle_*.data")}


def test_written_leaves_no_shuffle_files(spark):
    before, asked = shuffle_files(spark), spark.conf.get(tables.CLEANUP, None)
    out = tables.written(spark.range(1000).groupBy(F.col("id") % 7).count().repartition(3, "count"), "few")
    end = time.time() + 10  # executors remove them a moment later
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left and spark.conf.get(tables.CLEANUP, None) == asked
    assert out.count() == 7


def test_classes_keep_only_the_tables_that_they_read(spark):
    words = [f"w{i}" for i in range(80)]
    near = [(k, " ".join(words[:40] + [f"x{k}"] + words[40:])) for k in range(6)]
    mark = tables.folder_mark()
    out = order_minhash.classified(spark.createDataFrame(near, "doc_id long, text string"))
    standing = [p for _, p in tables._FOLDERS[mark:] if Path(p.removeprefix("file://")).exists()]
    assert {p.rsplit("oriel-", 1)[1].split("-")[0] for p in standing} <= {"features", "named", "large", "labels"}
    assert {r["class_id"] for r in out.collect()} == {0}


def test_greedy_order_of_texts_beyond_the_first_ranges(spark):
    draw = random.Random(3)
    hashes = [draw.getrandbits(64) - (1 << 63) for _ in range(17_000)]
    hashes += [h ^ 5 for h in hashes[:200]]
    ranks = draw.sample(range(10**6), len(hashes))
    rows = spark.createDataFrame([(f"{r:064x}", h) for r, h in zip(ranks, hashes, strict=True)], "rank string, hash long")
    kept = {r["rank"] for r in dedup.greedy_keep(rows, 5).filter("kept").collect()}
    lost = {f"{max(ranks[k], ranks[17_000 + k]):064x}" for k in range(200)}
    assert len(kept) == 17_000 and not kept & lost


def test_keys_of_hashes_are_not_broadcast(spark):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    rows = tables.written(spark.range(2000).select("id", F.xxhash64("id").alias("hash")), "rows")
    for df in (dedup.near_hashes(rows, rows, 5), dedup.near_any(rows.filter("id < 9"), rows, 5), dedup.near_hashes(rows, rows, 5, agree=2)):
        band = [x for x in plan(df).splitlines() if "Join" in x and "band" in x]
        assert band and all("SortMergeJoin" in x for x in band)


def test_keys_agree_with_all_pairs(spark):
    draw = random.Random(4)
    hashes = [draw.getrandbits(63) for _ in range(300)]
    hashes += [h ^ sum(1 << b for b in draw.sample(range(63), draw.randrange(1, 8))) for h in hashes[:200]]
    rows = spark.createDataFrame(list(enumerate(hashes)), "idx long, hash long").withColumn("split", F.when(F.col("idx") % 3 == 0, "a").otherwise("b"))
    near = [[i for i in range(k) if (hashes[i] ^ hashes[k]).bit_count() <= 5] for k in range(len(hashes))]
    got = {r["idx"]: r["match_idx"] for r in dedup.first_near(rows, 5).collect()}
    assert got == {k: min(x, default=None) for k, x in enumerate(near)}
    got = {r["idx"]: r["match_idx"] for r in dedup.split_leaks(rows, 5, "all_pairs").collect()}
    other = {k: [i for i in x if (i % 3 == 0) != (k % 3 == 0)] for k, x in enumerate(near)}
    assert got == {k: x[0] for k, x in other.items() if x}


def test_files_of_small_rows_are_dealt_to_many_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(f"{tmp_path}/a/{k % 3}/{k}", bytes([k])) for k in range(200)], "path string, content binary").coalesce(1)
    done = files.written_files(rows).withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in done}) >= spark.sparkContext.defaultParallelism and {r["length"] for r in done} == {1}
    tasks = files.hashed(spark.createDataFrame(done).select("path", "length").coalesce(1)).withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in tasks}) >= spark.sparkContext.defaultParallelism
    assert {r["path"]: r["sha256"] for r in tasks} == {f"{tmp_path}/a/{k % 3}/{k}": hashlib.sha256(bytes([k])).hexdigest() for k in range(200)}


def test_archives_are_streamed_and_read_in_parts(spark, tmp_path):
    want = {(f"{k % 3}.zip", f"d/{k}"): b"x" * (k % 50) for k in range(14_000)}
    rows = spark.createDataFrame([(f"{tmp_path}/{a}", n, c) for (a, n), c in want.items()], "path string, name string, content binary")
    assert {r["path"]: r["length"] for r in files.written_zips(rows).collect()} == {str(p): p.stat().st_size for p in tmp_path.iterdir()}
    got = readers.read_zip(spark, f"file://{tmp_path}", len(want)).collect()
    assert {(r["archive"].rsplit("/", 1)[1], r["name"]): (r["size"], r["sha256"]) for r in got} == {k: (len(c), hashlib.sha256(c).hexdigest()) for k, c in want.items()}


def test_long_texts_that_share_a_passage_are_no_pairs(spark):
    """In long texts the rare labels of a passage meet by chance; only pairs that share enough of them are made."""
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [" ".join(f"w{k}x{i}" for i in range(1500)) + f" {passage}" for k in range(30)]
    texts.append(texts[0].replace("w0x7 ", "other "))
    docs = order_minhash.keyed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    made = order_minhash.features(docs, np.empty(0, np.uint64), np.empty(0, np.int64))
    nodes = made.withColumnsRenamed({"doc_id": "node", "n_shingles": "n"}).withColumn("group", F.col("node"))
    assert [tuple(r) for r in order_minhash.rest_of_pairs(nodes).collect()] == [(0, 30)]


def test_alike_texts_share_enough_rare_labels():
    rng = np.random.default_rng(5)
    none, tested = (np.empty(0, np.uint64), np.empty(0, np.int64)), 0
    for n in (5, 9, 60, 255, 256, 257, 330, 900, 4000):
        for share in (0.8, 0.81, 0.85, 0.95, 1):
            m = int(n * rng.choice([share, 1, 1 / share]))
            kept = min(n, m, -int(-4 * (n + m) // 9))  # the fewest labels that a similarity of 0.8 shares
            own = rng.integers(0, 1 << 63, n + m).astype(np.uint64)
            a, b = own[:n], np.append(own[:kept], own[n : n + m - kept])
            if 9 * kept < 4 * (n + m):
                continue
            sizes = np.array([n, m])
            rare, size = order_minhash.rare_prefixes(np.append(a, b), sizes, *none)
            node, place = np.repeat([0, 1], size), np.append(np.arange(size[0]), np.arange(size[1]))
            got = order_minhash.rare_pairs(rare.view(np.int64), node, node, sizes[node], place, np.full(len(node), -1), np.zeros((len(node), 2), np.uint64), counted=True)
            assert got.shape == (1, 3) and got[0, 2] >= order_minhash.least_shared(sizes).min()
            tested += 1
    assert tested > 30


def test_pairs_are_verified_in_parts(spark, monkeypatch):
    words = [f"w{i}" for i in range(80)]
    rows = [(k, " ".join(words[:40] + [f"x{k}"] + words[40:])) for k in range(12)] + [(12, "quite another text of some words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = tables.written(spark.createDataFrame([(a, b) for b in range(13) for a in range(b)], "a long, b long"), "pairs")
    texts = tables.written(docs.select(F.col("doc_id").alias("node"), "text"), "texts")
    monkeypatch.setattr(order_minhash, "CARRIED", 1)
    parts = order_minhash.verified_parts(pairs, texts)
    got = [tuple(r) for p in parts for r in p.collect()]
    assert len(parts) > 3 and sorted(got) == sorted((a, b) for b in range(12) for a in range(b))
    assert {r["class_id"] for r in order_minhash.near_duplicate_classes(docs).collect()} == {0, 12}
