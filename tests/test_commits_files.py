"""Commit log and files in tasks."""

import hashlib
import os
import threading

import pytest

from oriel.sources import commits as C
from oriel.sources import files
from oriel.sources import readers as I


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_upserts_rewrite_only_their_buckets(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    d = spark.createDataFrame([(i, f"v{i}") for i in range(40)], "k long, v string")
    with pytest.raises(FileNotFoundError):
        C.read_table(spark, root)
    assert C.write_table(d, root, "k", buckets=8) == 1
    before = C._state(spark, root, 1)["buckets"]
    assert C.upsert_table(spark.createDataFrame([(3, "new"), (99, "more")], "k long, v string"), root) == 2
    after = C._state(spark, root, 2)["buckets"]
    assert 1 <= sum(before.get(b) != p for b, p in after.items()) <= 2 and len(after) <= 8
    want = {i: f"v{i}" for i in range(40)} | {3: "new", 99: "more"}
    assert rows(C.read_table(spark, root)) == sorted(want.items())
    assert rows(C.read_table(spark, root, 1)) == [(i, f"v{i}") for i in range(40)]
    assert C.upsert_table(d.limit(0), root) == 2
    assert C.write_table(d.limit(0), root, "k") == 3 and C.read_table(spark, root).count() == 0


def test_of_two_writers_one_gets_an_error(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    d = spark.createDataFrame([(i, "a") for i in range(10)], "k long, v string")
    C.write_table(d, root, "k", buckets=4)
    said = []

    def write(v):
        try:
            said.append(C.upsert_table(spark.createDataFrame([(1, v)], "k long, v string"), root, expected=1))
        except C.Conflict:
            said.append("conflict")

    threads = [threading.Thread(target=write, args=(v,)) for v in "bc"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(map(str, said)) == ["2", "conflict"]
    assert C.read_table(spark, root).count() == 10 and len(os.listdir(tmp_path / "t/data")) == 2
    assert not [n for n in os.listdir(tmp_path / "t/log") if n.startswith(".") and not n.endswith(".crc")]


def test_readers_always_see_a_table(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    d = spark.createDataFrame([(i, 0) for i in range(5)], "k long, v int")
    C.write_table(d, root, "k", buckets=2)
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append({r["v"] for r in C.read_table(spark, root).collect()})

    reader = threading.Thread(target=read)
    reader.start()
    for v in (1, 2, 3):
        C.write_table(spark.createDataFrame([(i, v) for i in range(5)], "k long, v int"), root, "k", buckets=2)
    stop.set()
    reader.join()
    assert seen and all(len(s) == 1 for s in seen)  # one version each time, never a mixture or none


def test_files_are_written_and_hashed_in_tasks(spark, tmp_path):
    data = {f"{tmp_path}/f/{n}": n.encode() * k for n, k in (("a.txt", 1), ("b.bin", 0), ("c d.JPG", 100_000))}
    d = spark.createDataFrame([(f"file://{p}" if "c d" not in p else p, bytearray(c)) for p, c in data.items()], "path string, content binary")
    for _ in range(2):  # again is the same
        assert {r["length"] for r in files.written_files(d).collect()} == {len(c) for c in data.values()}
    got = {r["path"].rsplit("/", 1)[1]: (r["length"], r["sha256"]) for r in I.file_hashes(spark, f"{tmp_path}/f").collect()}
    assert got == {p.rsplit("/", 1)[1]: (len(c), hashlib.sha256(c).hexdigest()) for p, c in data.items() if c}  # scans pass over empty files


def test_a_file_of_over_2_gb_is_hashed_in_pieces(tmp_path):
    import tracemalloc

    big = tmp_path / "big.bin"
    size = (2 << 30) + 5
    with open(big, "wb") as f:
        f.truncate(size)
    want = hashlib.sha256()
    piece = bytes(1 << 20)
    for _ in range(size >> 20):
        want.update(piece)
    want.update(bytes(size % (1 << 20)))
    tracemalloc.start()
    assert files.sha256_of(str(big)) == want.hexdigest()
    assert tracemalloc.get_traced_memory()[1] < 8 << 20
