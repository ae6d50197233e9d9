"""Curation, contracts, exports, change rules and stream forms on small tables."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from oriel.functions import expressions as X
from oriel.functions import hashing as H
from oriel.functions import media as M
from oriel.operators import curate as C
from oriel.operators import dedup as D
from oriel.operators import review as R
from oriel.operators import select as L
from oriel.operators import validate as V
from oriel.sources import readers as I
from oriel.sources import sinks as K
from oriel.streaming import frames as S


def slow_bits(text):
    from fractions import Fraction

    cells = [text[j * len(text) // 72 : (j + 1) * len(text) // 72] for j in range(72)]
    means = [Fraction(sum(map(ord, c)), len(c)) if c else Fraction(0) for c in cells]
    value = 0
    for r in range(8):
        for k in range(8):
            value = value * 2 + (means[r * 9 + k + 1] > means[r * 9 + k])
    return value - (1 << 64) if value >= 1 << 63 else value


def test_text_hash_reads_the_whole_text(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("abcé日z ") for _ in range(n)) for n in (0, 1, 5, 71, 72, 73, 500, 5000)] + [None]
    got = [x["h"] for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(H.text_difference_hash("t").alias("h")).collect()]
    assert got == [None if t is None else slow_bits(t) for t in texts]


def test_image_hash_joins_resize_and_bits(spark):
    r = np.random.default_rng(2)
    image = r.integers(0, 256, (32, 32))
    small = np.rint(M.area_resize(image, 8, 9))
    bits = "".join(str(int(a < b)) for row in small for a, b in zip(row, row[1:], strict=False))
    got = spark.createDataFrame([([int(v) for v in image.reshape(-1)],)], "p array<int>").select(H.image_difference_hash("p", F.lit(32), F.lit(32)).alias("h")).first()["h"]
    assert got % (1 << 64) == int(bits, 2)


def test_filling_by_rows_is_filling_whole():
    r = random.Random(4)
    for _ in range(60):
        w, h = r.randint(1, 25), r.randint(1, 25)
        polygons = [[(r.randint(-3, w + 2), r.randint(-3, h + 2)) for _ in range(r.randint(3, 6))] for _ in range(r.randint(0, 3))]
        want = np.zeros((h, w), int)
        for p in polygons:
            for y in range(h):
                for x in range(w):
                    odd, near = False, False
                    for (x1, y1), (x2, y2) in zip(p, p[1:] + p[:1], strict=True):
                        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                            odd = not odd
                        dx, dy = x2 - x1, y2 - y1
                        t = min(1, max(0, ((x - x1) * dx + (y - y1) * dy) / max(dx * dx + dy * dy, 1e-12)))
                        near |= max(abs(x1 + t * dx - x), abs(y1 + t * dy - y)) < 0.5
                    want[y, x] |= odd or near
        assert (M.fill_polygons(polygons, w, h) == want).all()


def test_bands_find_the_same_pairs_however_selective(spark, monkeypatch):
    r = random.Random(5)
    base = [r.getrandbits(63) for _ in range(12)]
    hashes = {b ^ sum(1 << k for k in r.sample(range(63), r.randint(0, 7))) for b in base for _ in range(25)}
    d = spark.createDataFrame([(h,) for h in hashes], "hash long")
    want = {(a, b) for a in hashes for b in hashes if (a ^ b).bit_count() <= 5}
    monkeypatch.setattr(D, "BAND_ROWS", 3)
    assert {tuple(x) for x in D.near_hashes(d, d, 5).collect()} == want == {tuple(x) for x in D.near_hashes(d, d, 5, agree=2).collect()}


def test_greedy_limit(spark):
    r = random.Random(6)
    base = [r.getrandbits(63) for _ in range(6)]
    rows = [(i, r.choice(base) ^ sum(1 << k for k in r.sample(range(63), r.randint(0, 4)))) for i in range(80)]
    kept = []
    for i, h in rows:
        if all((h ^ x).bit_count() > 5 for _, x in kept):
            kept.append((i, h))
    d = spark.createDataFrame(rows, "rank long, hash long")
    for limit in (1, 4, 1000):
        got = {x["rank"]: x["kept"] for x in D.greedy_keep(d, 5, limit=limit).collect()}
        assert [i for i, k in sorted(got.items()) if k] == [i for i, _ in kept][:limit]
        assert all(got[i] is None for i, _ in rows if len(kept) > limit and i > kept[limit - 1][0])


@pytest.mark.parametrize("most", [1, 3, 40])
def test_budget_walk_passes_over_what_does_not_fit(spark, most):
    r = random.Random(most)
    rows = [(f"k{i:03d}", r.randint(1, 60)) for i in range(120)]
    left, want = 300, []
    for k, n in rows:
        if n <= left and len(want) < most:
            left -= n
            want.append(k)
    got = L.budget_select(spark.createDataFrame(rows, "k string, n int"), "k", "n", 300, most).orderBy("take").collect()
    assert [x["k"] for x in got] == want


def test_sources_json_before_csv(spark, tmp_path):
    (tmp_path / "sources.csv").write_text("filename,title,source_url,license,artist\na.jpg,\"A, b\",u,CC0,x\nc.jpg,,v,,\n")
    got = [tuple(r) for r in I.read_sources(spark, str(tmp_path)).orderBy("set_index").collect()]
    assert got == [(1, "a.jpg", "A, b", "u", "CC0", "x"), (2, "c.jpg", "", "v", "", "")]
    (tmp_path / "sources.json").write_text(json.dumps([{"set_index": 7, "filename": "z.jpg", "title": "t"}]))
    assert [r["set_index"] for r in I.read_sources(spark, str(tmp_path)).collect()] == [7]
    (tmp_path / "sources.json").write_text("[]")
    with pytest.raises(ValueError):
        I.read_sources(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        I.read_sources(spark, str(tmp_path / "none"))


def test_pages_must_be_whole(spark):
    schema = "page_token string, next_page_token string, error_message string, files array<struct<path:string,size:long,url:string>>"
    page = lambda t, n, e="": (t, n, e, [(f"p{t}", 1, "u")])
    assert I.paged_files(spark.createDataFrame([page("", "b"), page("b", "")], schema)).count() == 2
    for bad in ([page("", "b")], [page("", "b"), page("b", "", "quota")], [page("", "b"), page("b", ""), page("b", "")], [page("", ""), page("c", "")]):
        with pytest.raises(Exception, match="inventory"):
            I.paged_files(spark.createDataFrame(bad, schema)).collect()


def test_zip_and_space_and_retries(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("d/x.txt", "hello")
        z.writestr("y.txt", "")
    assert {(r["name"], r["size"]) for r in I.read_zip(spark, str(tmp_path / "a.zip"), 2).collect()} == {("d/x.txt", 5), ("y.txt", 0)}
    with pytest.raises(Exception, match="3 files"):
        I.read_zip(spark, str(tmp_path / "a.zip"), 3).collect()
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("../x.txt", "hello")
    with pytest.raises(Exception, match="climbs"):
        I.read_zip(spark, str(tmp_path / "b.zip")).collect()
    assert I.require_free(spark, str(tmp_path), 1) > 0
    with pytest.raises(OSError):
        I.require_free(spark, str(tmp_path), 1 << 62)
    waits, tries = [], iter([503, 429, 0])

    def fetch():
        status = next(tries)
        if status:
            fault = OSError()
            fault.status = status
            raise fault
        return "ok"

    assert I.fetched(fetch, wait=waits.append) == "ok" and waits == [0.5, 1.0]
    tries = iter([404])
    with pytest.raises(OSError):
        I.fetched(fetch, wait=waits.append)


def test_export_is_whole_or_absent(spark, tmp_path):
    lines = spark.createDataFrame([("object", "train", "a", "0 1 1 1 1"), ("tactile", "test", "b", "0 0 0 1 1 1 0")], "task string, split string, sample_id string, line string")
    samples = lines.select("sample_id", "split")
    path = str(tmp_path / "out")
    K.export_dataset(lines, samples, path, {"object": ["x", 'y"z'], "tactile": ["t"]}, {"dataset_version": "v", "source_manifest_sha256": "h"})
    assert (tmp_path / "out" / "object.yaml").read_text() == 'train: images/train\nval: images/val\ntest: images/test\nnames:\n  0: "x"\n  1: "y\\"z"\n'
    assert json.loads((tmp_path / "out" / "export_manifest.json").read_text())["dataset_version"] == "v"
    assert spark.read.parquet(f"{path}/labels").count() == 2 == spark.read.json(f"{path}/samples").count()
    with pytest.raises(FileExistsError):
        K.export_dataset(lines, samples, path, {}, {})
    broken = lines.withColumn("line", F.raise_error(F.lit("no line")).cast("string"))
    with pytest.raises(Exception, match="no line"):
        K.export_dataset(broken, samples, str(tmp_path / "other"), {}, {})
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_merge_wants_ready_and_distinct_inputs(spark):
    a = spark.createDataFrame([(1, "train"), (2, "validation")], "key long, split string")
    b = spark.createDataFrame([(3, "test")], "key long, split string")
    none = a.select("key").limit(0)
    assert C.merged_sets([a, b], [True, True], "key", "split", none).count() == 3
    for inputs, ready, protected, text in (([a, b], [True, False], none, "ready"), ([a, b, b], [True] * 3, none, "two inputs"), ([a, b], [True, True], b.select("key"), "protected"), ([a], [True], none, "split has no row")):
        with pytest.raises(Exception, match=text):
            C.merged_sets(inputs, ready, "key", "split", protected).collect()


def test_review_changes_are_bound_and_latest(spark):
    reviews = spark.createDataFrame([("a", "h0", "old", "1"), ("b", "h1", "old", "1")], "id string, sha string, status string, at string")
    changes = spark.createDataFrame([("a", "", "first", "2"), ("a", "", "second", "3"), ("c", "", "new", "2")], reviews.schema)
    samples = spark.createDataFrame([("a", "ha"), ("c", "hc")], "id string, sha string")
    got = {r["id"]: (r["sha"], r["status"]) for r in R.upsert(reviews, R.bound_changes(changes, samples, "id", ["sha"]), "id", "at").collect()}
    assert got == {"a": ("ha", "second"), "b": ("h1", "old"), "c": ("hc", "new")}
    with pytest.raises(Exception, match="known sample"):
        R.bound_changes(changes, samples.filter("id = 'a'"), "id", ["sha"]).collect()
    with pytest.raises(Exception, match="changed twice"):
        R.upsert(reviews, changes, "id").collect()


def test_marking_asks_the_whole_table(spark):
    rows = [("a", "provisional", "", "", ""), ("b", "human_reviewed", "x", "2024-05-01T10:00:00Z", "")]
    schema = "id string, review_status string, reviewer string, reviewed_at string, notes string"
    good = spark.createDataFrame(rows, schema)
    keys = spark.createDataFrame([("a",)], "id string")
    assert R.mark_human_reviewed(good, keys, "id", "me", "2024-05-02T10:00:00Z").filter("review_status = 'human_reviewed'").count() == 2
    bad = spark.createDataFrame([*rows, ("c", "ambiguous", "", "", "")], schema)
    with pytest.raises(Exception, match="isn't valid"):
        R.mark_human_reviewed(bad, keys, "id", "me", "2024-05-02T10:00:00Z").collect()
    with pytest.raises(Exception, match="unknown keys"):
        R.mark_human_reviewed(good, spark.createDataFrame([("z",)], "id string"), "id", "me", "2024-05-02T10:00:00Z").collect()


def test_first_decodable_and_seeds(spark):
    d = spark.createDataFrame([("k", 1, None), ("k", 2, "b"), ("k", 3, "c")], "g string, n int, v string")
    assert tuple(C.first_decodable(d, ["g"], "n", "v").first()) == ("k", 2, "b")
    with pytest.raises(Exception, match="decoded"):
        C.first_decodable(d.filter("n = 1"), ["g"], "n", "v").collect()
    constants = spark.createDataFrame([("a.jpg", 0, [(0.123456, 0.5)])], "filename string, place int, points array<struct<x:double,y:double>>")
    sizes = spark.createDataFrame([("a.jpg", 100.0, 50.0)], "filename string, width double, height double")
    assert C.seeded_shapes(constants, sizes, "t").first()["points"][0] == (12.35, 25.0)
    with pytest.raises(Exception, match="isn't there"):
        C.seeded_shapes(constants, sizes.limit(0), "t").collect()


def test_labels_and_case(spark):
    r = spark.range(1).select(
        V.labels_equal(F.create_map(F.lit("0"), F.lit("a"), F.lit("1"), F.lit("b")), F.create_map(F.lit(1), F.lit("b"), F.lit(0), F.lit("a"))).alias("same"),
        V.labels_equal(F.create_map(F.lit("0"), F.lit("a")), F.create_map(F.lit(1), F.lit("a"))).alias("other"),
        (X.casefold(F.lit("Straße")) == X.casefold(F.lit("STRASSE"))).alias("fold"), X.url_encoded(F.lit("a b/c")).alias("url"), X.now_iso().alias("now"),
    ).first()
    assert r["same"] and not r["other"] and r["fold"] and r["url"] == "a%20b%2Fc" and r["now"].endswith("+00:00")


def frames_of(spark, rows):
    return spark.createDataFrame(rows, "frame_id long, stream long, ms long, status string, value double").withColumn("captured_at", F.timestamp_millis("ms"))


def test_busy_frames_are_dropped(spark, tmp_path):
    r = random.Random(7)
    rows, ms = [], {0: 0, 1: 0}
    for i in range(120):
        k = r.randrange(2)
        ms[k] += r.choice([5, 20, 45, 300])
        rows.append((i, k, ms[k], "view", 0.0))
    want, until = {}, {}
    for i, k, t, _, _ in rows:
        want[i] = k in until and t < until[k]
        if not want[i]:
            until[k] = t + 100
    f = frames_of(spark, rows)
    assert {x["frame_id"]: x["dropped"] for x in S.accepted_when_free(f, 100).collect()} == want
    src = str(tmp_path / "in")
    f.coalesce(1).write.parquet(src)
    q = S.busy_stream(spark.readStream.schema(f.schema).parquet(src), 100).writeStream.outputMode("append").format("memory").queryName("busy").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    q.stop()
    assert {x["frame_id"]: x["dropped"] for x in spark.table("busy").collect()} == want


def test_state_machine(spark):
    # (ms, seen, hazard, failed, slow, stop) and the state that follows
    steps = [
        (0, 0, 0, 0, 0, 0, "initializing"), (100, 1, 0, 0, 0, 0, "tactileCandidate"), (200, 1, 0, 0, 0, 0, "tactileCandidate"), (300, 1, 0, 0, 0, 0, "tactileGuidance"),
        (400, 0, 0, 0, 0, 0, "tactileGuidance"), (800, 0, 0, 0, 0, 0, "tactileGuidance"), (900, 0, 0, 0, 0, 0, "uncertain"), (1000, 0, 1, 0, 0, 0, "hazardStop"), (1100, 0, 0, 0, 0, 0, "hazardStop"),
        (1200, 0, 0, 0, 0, 0, "hazardStop"), (1300, 0, 0, 0, 0, 0, "uncertain"), (1400, 0, 0, 1, 0, 0, "systemFailure"), (1900, 0, 0, 0, 0, 0, "uncertain"), (2401, 0, 0, 0, 0, 0, "systemFailure"),
        (2800, 0, 0, 0, 0, 0, "uncertain"), (2900, 0, 0, 0, 0, 0, "lostPath"), (3300, 0, 0, 0, 0, 0, "lostPath"), (3700, 0, 0, 0, 0, 0, "lostPath"), (3900, 0, 0, 0, 1, 0, "degraded"), (4000, 0, 0, 0, 0, 0, "objectOnly"), (4100, 1, 1, 1, 0, 1, "stopped"),
    ]
    f = spark.createDataFrame([(i, 1, s[0], *map(bool, s[1:6])) for i, s in enumerate(steps)], "frame_id long, stream long, ms long, seen boolean, hazard boolean, failed boolean, slow boolean, stop boolean").withColumn("captured_at", F.timestamp_millis("ms"))
    got = [r["state"] for r in S.machine_states(f, "seen", "hazard", "failed", "slow", "stop", told_ms=1000).orderBy("frame_id").collect()]
    assert got == [s[-1] for s in steps] and set(got) == set(S.STATES)
    unknown = f.withColumns({c: F.lit(None).cast("boolean") for c in ("hazard", "failed", "slow", "stop")})
    assert {r["state"] for r in S.machine_states(unknown, "seen", "hazard", "failed", "slow", "stop").collect()} == {"stopped"}


def test_feedback_and_freeze(spark):
    f = spark.createDataFrame([(1, 1, 0, "object", "a"), (2, 1, 0, "drop", "b"), (3, 1, 50, "object", "a"), (4, 1, 60, "obstacle", "c"), (5, 1, 70, "obstacle", "c"), (6, 1, 900, "object", "a"), (7, 1, 950, "other", "a")], "frame_id long, stream long, ms long, kind string, tracked string").withColumn("captured_at", F.timestamp_millis("ms"))
    got = [(r["frame_id"], r["priority"], r["cancels"]) for r in S.announced(f, "kind", "tracked", 500).orderBy("frame_id").collect()]
    assert got == [(2, 1, True), (4, 2, True), (5, 2, True), (6, 5, False)]
    g = spark.createDataFrame([(1, 1, 0, "h"), (2, 1, 10, "h"), (3, 1, 10, "i"), (4, 1, 20, "j"), (5, 1, 30, None), (6, 1, 40, None)], "frame_id long, stream long, ms long, hash string").withColumn("captured_at", F.timestamp_millis("ms"))
    assert [r["frame_id"] for r in S.frozen(g, ("hash", "captured_at")).orderBy("frame_id").collect()] == [2, 3]
    d = spark.createDataFrame([([1.0, float("nan"), 3.0, 0.0, None],), ([0.0],), ([],)], "d array<double>").select(S.area_depth("d").alias("m")).collect()
    assert [r["m"] for r in d] == [2.0, None, None]


def test_labelled_dataset(spark):
    from oriel.operators import curate as C

    src = spark.createDataFrame([("a.jpg", "Malam", "https://wikimedia.org/x", "CC0", None), ("b.jpg", "", "", None, "me")], "filename string, title string, source string, license string, artist string")
    img = spark.createDataFrame([("a.jpg", "ha", 10.0, 10.0), ("b.jpg", "hb", 10.0, 10.0)], "filename string, sha256 string, width double, height double")
    grp = spark.createDataFrame([("a.jpg", "l1", "s1"), ("b.jpg", "l2", "s2")], "filename string, location_id string, session_id string")
    pts = [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0)]
    kind = "filename string, place int, label string, shape_type string, points array<struct<x:double,y:double>>"
    shp = spark.createDataFrame([("a.jpg", 1, "paving", "polygon", pts), ("a.jpg", 0, "edge", "polygon", pts)], kind)
    ann, meta = C.labelled_dataset(src, img, shp, grp, ["paving", "edge"])
    got = {r["sample_id"]: (r["n_shapes"], r["review_status"], [t["class_id"] for t in r["tactile"]]) for r in ann.collect()}
    assert got == {"ha": (2, "provisional", [1, 0]), "hb": (0, "unreviewed", [])}
    rows = {r["source_path"]: r for r in meta.collect()}
    assert rows["a.jpg"]["lighting"] == "low_light" and rows["b.jpg"]["location_id"] == "l2" and rows["b.jpg"]["surface"] == "mixed"
    for bad in ((src.limit(1), img, shp, grp), (src, img.unionByName(img.limit(1)), shp, grp), (src, img, shp, grp.limit(1)), (src, img, shp.withColumn("label", F.lit("other")), grp), (src, img, shp.withColumn("shape_type", F.lit("circle")), grp), (src, img, shp.withColumn("filename", F.lit("c.jpg")), grp)):
        with pytest.raises(Exception, match="match one to one|valid polygon"):
            C.labelled_dataset(*bad, ["paving", "edge"])[0].collect()


def test_missing_members(spark):
    from oriel.operators import pairing as P

    d = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "other"), ("b", "x"), ("b", None), (None, "y")], "g string, v string")
    assert {r["g"]: (r["missing"], r["complete"]) for r in P.missing_members(d, ["g"], "v", ["x", "y"]).collect()} == {"a": ([], True), "b": (["y"], False), None: (["x"], False)}
