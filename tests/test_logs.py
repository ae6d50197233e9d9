"""Growing logs: every whole line once, whatever the cuts, the batches and the restarts; files brought into a folder."""

import pytest
from pyspark.errors import StreamingQueryException

from oriel.sources import files, logs

TEXT = b"one\n\ntwo \xc3\xa9\n" + b"x" * 300 + b"\nlast\n"


def test_each_line_is_read_by_one_task(tmp_path):
    (tmp_path / "a.log").write_bytes(TEXT + b"open")
    want, at = [], 0
    for line in TEXT.split(b"\n")[:-1]:
        want.append((at, line))
        at += len(line) + 1
    for size in (1, 2, 5, 7, 100, 301, 10_000):
        parts = logs.LogReader({"path": str(tmp_path), "taskbytes": size}).partitions()
        assert [x for p in parts for x in logs.lines_of(p)] == want, size


def test_pieces_of_long_lines(tmp_path, monkeypatch):
    (tmp_path / "a.log").write_bytes(TEXT + b"y" * 50)
    want = [x for p in logs.LogReader({"path": str(tmp_path)}).partitions() for x in logs.lines_of(p)]
    monkeypatch.setattr(logs, "PIECE", 3)
    for size in (4, 90):
        parts = logs.LogReader({"path": str(tmp_path), "taskbytes": size}).partitions()
        assert parts[-1].last == len(TEXT) and [x for p in parts for x in logs.lines_of(p)] == want


def test_a_table_of_lines(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(TEXT)
    (tmp_path / "b.log").write_bytes(b"\xff\n")
    (tmp_path / ".hidden").write_bytes(b"no\n")
    got = sorted((r["log"], r["at"], r["line"]) for r in logs.log_lines(spark, str(tmp_path), task_bytes=4).collect())
    assert [x[2] for x in got] == ["one", "", "two é", "x" * 300, "last", "�"] and got[2][:2] == ("a.log", 5)
    assert logs.log_lines(spark, f"{tmp_path}/none").count() == 0


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, out = tmp_path / "logs", str(tmp_path / "out")
    folder.mkdir()

    def run():
        q = logs.log_lines(spark, str(folder), stream=True, task_bytes=16).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r["line"] for r in spark.read.parquet(out).collect())

    def add(name, data):
        with open(folder / name, "ab") as f:
            f.write(data)

    add("a", b"a1\na2\na3 is op")
    assert run() == ["a1", "a2"]
    add("a", b"en\n")
    add("b", b"b1\n" * 9)
    assert run() == ["a1", "a2", "a3 is open", *["b1"] * 9]
    assert run() == ["a1", "a2", "a3 is open", *["b1"] * 9]
    (folder / "a").write_bytes(b"a1\n")
    add("b", b"b2\n")
    with pytest.raises(StreamingQueryException):
        run()


def test_files_are_fetched_until_their_size_is_right(tmp_path):
    asked = []

    def fetch(url):
        asked.append(url)
        yield b"ab"
        if len(asked) < 3:
            raise OSError("lost")
        yield b"cd"

    get = lambda size, attempts=5: files.brought(str(tmp_path), "x/a.bin", size, "u", fetch, attempts, 0.0)
    assert get(4) == (4, "fetched") and len(asked) == 3 and (tmp_path / "x/a.bin").read_bytes() == b"abcd"
    assert get(4) == (4, "reused") and get(None) == (4, "reused") and len(asked) == 3
    with pytest.raises(OSError, match="5 are expected"):
        get(5, attempts=2)
    assert len(asked) == 5 and [p.name for p in (tmp_path / "x").iterdir()] == ["a.bin"]
    for path in ("../a", "/a"):
        with pytest.raises(ValueError, match="climbs out"):
            files.brought(str(tmp_path), path, 4, "u", fetch, 1, 0.0)


def test_refused_files_end_the_run(spark, tmp_path):
    rows = spark.createDataFrame([("a", 3, f"{tmp_path}/none")], "path string, size long, url string")
    with pytest.raises(Exception, match="none"):
        files.materialised(rows, f"{tmp_path}/out", attempts=1).count()
    assert files.materialised(rows.limit(0), f"{tmp_path}/out").count() == 0
