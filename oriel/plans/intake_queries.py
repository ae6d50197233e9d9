"""Queries that go through files: tables are written as manifests, read by the readers and compared with the tables;
and curation, review changes, contracts and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oriel.functions import expressions as X
from oriel.functions import geometry as G
from oriel.functions.hashing import image_difference_hash
from oriel.functions import masks as MK
from oriel.functions.media import polygon_mask
from oriel.operators import curate as C
from oriel.operators import metrics as M
from oriel.operators import pairing as P
from oriel.operators import review as R
from oriel.operators import select as S
from oriel.operators import validate as V
from oriel.plans.registry import query, table
from oriel.plans.tables import shared_path, written
from oriel.sources import commits, logs, readers, schemas, sinks
from oriel.sources.files import hashed, materialised, written_files, written_zips


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer")


_INTAKE = {"source_path": "c_name", "session_id": "CAST(c_custkey AS {s})", "location_id": "CAST(c_nationkey AS {s})", "notes": "' ' || c_mktsegment || ' \"q\", '"}


@query(f"SELECT {', '.join(('trim(' + _INTAKE[c].format(s='varchar') + ')' if c in _INTAKE else chr(39) + c + chr(39)) + ' AS ' + c for c in schemas.INTAKE_COLUMNS)} FROM customer")
def csv_intake(spark, sf_dir):
    rows = _customers(spark, sf_dir).select(*(F.expr(_INTAKE[c].format(s="string")).alias(c) if c in _INTAKE else F.lit(c).alias(c) for c in schemas.INTAKE_COLUMNS))
    path = shared_path(spark, "intake")
    sinks.create_once(rows, path)
    return readers.read_intake(spark, path)


@query("""SELECT CAST(doc_id AS varchar) AS sample_id, source AS source_path, '' AS source_sha256, lang AS dataset_role, '' AS prediction_tactile_present, CAST(n_chars AS varchar) AS prediction_mask_coverage,
'' AS ground_truth_tactile_present, ' a ' AS ground_truth_mask_path, '' AS ground_truth_mask_sha256, '' AS annotation_origin, '' AS annotation_id, 'unreviewed' AS review_status, '' AS reviewer, '' AS reviewed_at, '' AS notes FROM documents""")
def csv_truth_legacy(spark, sf_dir):
    """A manifest of nine columns, as older files have them; the others come back empty and cells aren't trimmed."""
    d = table(spark, sf_dir, "documents")
    cells = {"sample_id": F.col("doc_id").cast("string"), "source_path": F.col("source"), "dataset_role": F.col("lang"), "prediction_mask_coverage": F.col("n_chars").cast("string"), "ground_truth_mask_path": F.lit(" a "), "review_status": F.lit(R.UNREVIEWED)}
    path = shared_path(spark, "truth")
    rows = d.select(*(cells.get(c, F.lit("")).alias(c) for c in schemas.TRUTH_LEGACY))
    rows.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_truth(spark, path)


_REVIEW = "CASE WHEN quality = 1 THEN 'human_reviewed' ELSE 'ambiguous' END"


@query(f"SELECT CAST(doc_id AS varchar) AS sample_id, sha256(CAST(doc_id AS varchar)) AS source_sha256, '' AS annotation_sha256, {_REVIEW} AS review_status, 'someone' AS reviewer, '2024-05-01T10:00:00Z' AS reviewed_at, CASE WHEN quality = 1 THEN '' ELSE 'unclear' END AS notes FROM labels")
def csv_reviews(spark, sf_dir):
    path = shared_path(spark, "reviews")
    sinks.replace(_reviews(spark, sf_dir), path)
    return readers.read_reviews(spark, path)


def _reviews(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    good = F.col("quality") == 1
    return table(spark, sf_dir, "labels").select(
        i.alias("sample_id"), F.sha2(i, 256).alias("source_sha256"), F.lit("").alias("annotation_sha256"), F.when(good, R.HUMAN_REVIEWED).otherwise(R.AMBIGUOUS).alias("review_status"),
        F.lit("someone").alias("reviewer"), F.lit("2024-05-01T10:00:00Z").alias("reviewed_at"), F.when(good, "").otherwise("unclear").alias("notes"),
    )


@query("SELECT row_number() OVER (ORDER BY s_suppkey) AS set_index, s_name AS filename, s_name || ' title' AS title, 'https://example.org/' || s_suppkey AS source, 'CC0' AS license, CAST(s_nationkey AS varchar) AS artist FROM supplier")
def source_table_csv(spark, sf_dir):
    """Without a JSON file the CSV is read, and its rows are numbered in their order. Each range is a file of its own."""
    s = table(spark, sf_dir, "supplier").repartitionByRange(8, "s_suppkey").sortWithinPartitions("s_suppkey")
    folder = shared_path(spark, "sources")
    rows = s.select(F.col("s_name").alias("filename"), F.concat("s_name", F.lit(" title")).alias("title"), F.concat(F.lit("https://example.org/"), F.col("s_suppkey").cast("string")).alias("source_url"), F.lit("CC0").alias("license"), F.col("s_nationkey").cast("string").alias("artist"))
    sinks.create_once(rows, f"{folder}/sources.csv")
    return readers.read_sources(spark, folder)


@query("SELECT CAST(s_suppkey * 2 AS bigint) AS set_index, s_name AS filename, CAST(NULL AS varchar) AS title, 'https://example.org/' || s_suppkey AS source, 'CC0' AS license, CAST(s_nationkey AS varchar) AS artist FROM supplier")
def source_table_json(spark, sf_dir):
    """Lists of up to a hundred suppliers, each a file of its own."""
    s = S.ranked(table(spark, sf_dir, "supplier"), ["s_suppkey"]).withColumn("list", F.floor(F.col("rank") / 100))
    folder = shared_path(spark, "sources")
    fields = F.struct((F.col("s_suppkey") * 2).alias("set_index"), F.col("s_name").alias("filename"), F.concat(F.lit("https://example.org/"), F.col("s_suppkey").cast("string")).alias("source"), F.lit("CC0").alias("license"), F.col("s_nationkey").cast("string").alias("artist"))
    lists = s.groupBy("list").agg(F.to_json(F.collect_list(fields)).alias("value")).select("value")
    lists.write.option("maxRecordsPerFile", 1).text(f"{folder}/sources.json")
    return readers.read_sources(spark, folder)


@query("SELECT CAST(vec_id AS varchar) AS sample_id, sha256(CAST(vec_id AS varchar)) AS source_sha256, len(embedding) // 2 AS n_points, label AS class_id, CAST(embedding[1] AS double) AS first_x FROM embeddings")
def json_annotations(spark, sf_dir):
    i = F.col("vec_id").cast("string")
    pairs = F.transform(F.sequence(F.lit(1), F.size("embedding") - 1, F.lit(2)), lambda k: F.array(F.element_at("embedding", k).cast("double"), F.element_at("embedding", k + 1).cast("double")))
    shape = F.array(F.struct(F.col("label").cast("string").alias("label"), pairs.alias("points")))
    rows = table(spark, sf_dir, "embeddings").select(F.lit(1).alias("schema_version"), i.alias("sample_id"), F.sha2(i, 256).alias("source_sha256"), F.expr("CAST(array() AS array<struct<label:string,bbox:array<double>>>)").alias("objects"), shape.alias("tactile"))
    path = shared_path(spark, "annotations")
    rows.write.json(path, ignoreNullFields=False)
    found = spark.read.schema(schemas.ANNOTATION).json(path, mode="FAILFAST")
    found = V.require(found, F.col("schema_version") == 1, "unsupported annotation version").select("sample_id", "source_sha256", F.inline("tactile"))
    return found.select("sample_id", "source_sha256", F.size("points").alias("n_points"), F.col("label").cast("int").alias("class_id"), F.col("points")[0][0].alias("first_x"))


_LINE = "l_linenumber % 3 || ' 0.1 ' || (l_discount * 10) || ' 0.9 ' || l_tax || ' 0.9 0.9'"
_LINE_DF = "concat(cast(l_linenumber % 3 AS string), ' 0.1 ', cast(l_discount * 10 AS string), ' 0.9 ', cast(l_tax AS string), ' 0.9 0.9')"


@query("""SELECT error, count(*) AS lines FROM (SELECT CASE WHEN l_linenumber % 3 <> 0 THEN 'wrong_class' WHEN l_discount * 10 > 1 THEN 'bad_coordinate'
WHEN abs(0.1 * l_tax - 0.9 * (l_discount * 10) + 0.9 * 0.9 - 0.9 * l_tax + 0.9 * (l_discount * 10) - 0.1 * 0.9) / 2 <= 1e-8 THEN 'no_area' END AS error FROM lineitem) GROUP BY error""")
def polygon_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.expr(_LINE_DF).alias("value"))
    return M.value_counts(readers.parse_polygon_lines(lines), "error").withColumnRenamed("rows", "lines")


@query("SELECT 'f' || n_nationkey AS stem, CAST(length(n_name) AS bigint) AS length, sha256(n_name) AS sha256, CASE WHEN n_nationkey % 2 = 0 THEN '.txt' ELSE '.jpg' END AS suffix FROM nation")
def file_scan(spark, sf_dir):
    """Files of either suffix are listed in any case and hashed whole."""
    folder = shared_path(spark, "files")
    name = F.concat(F.lit(f"{folder}/f"), F.col("n_nationkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, ".txt").otherwise(".JPG"))
    table(spark, sf_dir, "nation").select(name.alias("path"), F.col("n_name").cast("binary").alias("content")).transform(written_files).count()
    files = readers.list_files(spark, folder, (".jpg", ".txt")).select("path", "length", "stem", X.suffix("path").alias("suffix"))
    return files.join(readers.file_hashes(spark, folder).select("path", "sha256"), "path").select("stem", "length", "sha256", "suffix")


@query("SELECT 'parts' || p_size || '.zip' AS archive, 'd/' || p_partkey || '.txt' AS name, CAST(octet_length(encode(p_name)) AS bigint) AS size, sha256(p_name) AS sha256 FROM part WHERE p_size IS NOT NULL")
def zip_members(spark, sf_dir):
    """Parts as members of archives, one for each size, packed by the tasks that hold them."""
    folder = shared_path(spark, "zip")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").filter("p_size IS NOT NULL")
    path = F.concat(F.lit(f"{folder}/parts"), F.col("p_size").cast("string"), F.lit(".zip"))
    name = F.concat(F.lit("d/"), F.col("p_partkey").cast("string"), F.lit(".txt"))
    p.select(path.alias("path"), name.alias("name"), F.col("p_name").cast("binary").alias("content")).transform(written_zips).count()
    found = readers.read_zip(spark, folder, p.count())
    return found.select(F.substring_index("archive", "/", -1).alias("archive"), "name", "size", "sha256")


@query("SELECT 'f' || p_partkey AS stem, 'images/f' || p_partkey || '.JPG' AS image, 'labels/f' || p_partkey || '.txt' AS label FROM part WHERE p_size < 30")
def image_label_files(spark, sf_dir):
    """Images of small parts, label files of all parts and suppliers: labels without an image are left out."""
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    named = lambda df, first, key, end: df.select(F.concat(F.lit(first), F.col(key).cast("string"), F.lit(end)).alias("path")).select(X.stem("path").alias("stem"), "path")
    labels = named(p, "labels/f", "p_partkey", ".txt").unionByName(named(s, "labels/s", "s_suppkey", ".txt"))
    return readers.image_label_pairs(named(p.filter("p_size < 30"), "images/f", "p_partkey", ".JPG"), labels)


@query("SELECT event_id, user_id, event_type, value FROM events")
def log_lines(spark, sf_dir):
    """Events as logs of up to a thousand lines, written by tasks and read by ranges of bytes."""
    folder = shared_path(spark, "logs")
    line = F.to_json(F.struct("event_id", "user_id", "event_type", "value"), {"ignoreNullFields": "false"})
    e = S.ranked(table(spark, sf_dir, "events"), ["event_id"]).select(F.floor(F.col("rank") / 1000).alias("log"), F.concat(line, F.lit("\n")).alias("line"))
    files = e.groupBy("log").agg(F.concat_ws("", F.collect_list("line")).cast("binary").alias("content"))
    files.select(F.concat(F.lit(f"{folder}/"), F.col("log").cast("string"), F.lit(".log")).alias("path"), "content").transform(written_files).count()
    event = F.from_json("line", "event_id long, user_id long, event_type string, value double", {"mode": "FAILFAST"})
    return logs.log_lines(spark, folder, task_bytes=1 << 16).select(event.alias("e")).select("e.*")


@query("SELECT 'd/' || p_partkey || '.txt' AS path, CAST(octet_length(encode(p_name)) AS bigint) AS length, CASE WHEN p_partkey % 3 = 0 THEN 'reused' ELSE 'fetched' END AS status, sha256(p_name) AS sha256 FROM part")
def materialised_files(spark, sf_dir):
    """Parts brought from one folder into another, which has a third of them already, and of another third a shorter file."""
    origin, cache = shared_path(spark, "origin"), shared_path(spark, "cache")
    name, key = F.concat(F.lit("d/"), F.col("p_partkey").cast("string"), F.lit(".txt")), F.col("p_partkey") % 3
    p = table(spark, sf_dir, "part").select(name.alias("name"), F.col("p_name").cast("binary").alias("content"), key.alias("k"))
    at = lambda folder: F.concat(F.lit(f"{folder}/"), F.col("name")).alias("path")
    written_files(p.select(at(origin), "content")).count()
    written_files(p.filter("k < 2").select(at(cache), F.when(F.col("k") == 1, F.substring("content", 2, 1 << 30)).otherwise(F.col("content")).alias("content"))).count()
    rows = p.select(F.col("name").alias("path"), F.octet_length("content").cast("long").alias("size"), at(origin).alias("url"))
    # What tasks did is written before it is read twice: a second run would reuse everything.
    done = written(materialised(rows, cache), "done")
    hashes = hashed(done.select(F.concat(F.lit(f"{cache}/"), F.col("path")).alias("path"), "length")).select("path", "sha256")
    return done.join(hashes.select(F.substring("path", len(cache) + 2, 1 << 20).alias("path"), "sha256"), "path")


@query("SELECT p_name AS path, CAST(p_size AS bigint) AS size, 'https://example.org/' || p_partkey AS url FROM part")
def paged_inventory(spark, sf_dir):
    """Parts as pages of a fetched inventory, a hundred to a page, each naming the next."""
    p = S.ranked(table(spark, sf_dir, "part"), ["p_partkey"]).withColumn("page", F.floor((F.col("rank") - 1) / 100))
    files = F.collect_list(F.struct(F.col("p_name").alias("path"), F.col("p_size").cast("long").alias("size"), F.concat(F.lit("https://example.org/"), F.col("p_partkey").cast("string")).alias("url")))
    last = F.max("page").over(Window.partitionBy())
    pages = p.groupBy("page").agg(files.alias("files")).withColumn("last", last)  # one row for each page
    token = lambda c: F.when(c > 0, c.cast("string")).otherwise("")
    pages = pages.select(token(F.col("page")).alias("page_token"), F.when(F.col("page") < F.col("last"), (F.col("page") + 1).cast("string")).otherwise("").alias("next_page_token"), F.lit("").alias("error_message"), "files")
    path = shared_path(spark, "pages")
    pages.write.json(path)
    return readers.paged_files(spark.read.schema(schemas.INVENTORY_PAGE).json(path, mode="FAILFAST"))


@query("SELECT p_type AS title, 'CC-BY' AS licence, min(p_name) AS url FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size < 30) GROUP BY p_type ORDER BY p_type LIMIT 3")
def filtered_inventory(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    few = p.filter("p_size < 30").select("p_brand").distinct()
    rows = p.join(few, "p_brand", "left_semi").select(F.col("p_type").alias("title"), F.lit("CC-BY").alias("licence"), F.col("p_name").alias("url"))
    return readers.filtered_inventory(rows.unionByName(rows.withColumn("licence", F.lit("other")).withColumn("title", F.lit("A"))), ["cc-by"], 3)


@query("SELECT p_partkey FROM part WHERE NOT contains(lower(p_name), 'a') AND NOT contains(lower(p_name), '7')")
def without_words(spark, sf_dir):
    return readers.without_words(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", ["A", "7"]).select("p_partkey")


@query("SELECT filename, status, CAST(n AS integer) AS shape_count, list_filter([CASE WHEN copy OR h IN (SELECT sha256(text) FROM benchmark) THEN 'duplicate_or_protected' END, CASE WHEN n IS NOT NULL AND w <> 60 THEN 'dimensions' END, CASE WHEN has AND bad THEN 'image_path' END, CASE WHEN outside THEN 'shapes' END], lambda x: x IS NOT NULL) AS issues FROM (SELECT CAST(doc_id AS varchar) AS filename, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY CAST(doc_id AS varchar)) > 1 AS copy, quality IS NOT NULL AS has, CASE WHEN quality IS NULL THEN 'no_json_needs_presence_review' WHEN toxic = 1 THEN 'explicit_empty_needs_review' ELSE 'labeled_needs_visual_review' END AS status, CASE WHEN quality IS NULL OR toxic = 1 THEN 0 ELSE 1 END AS n, CASE WHEN quality = 0 THEN 61 ELSE 60 END AS w, lang = 'fr' AS bad, coalesce(toxic = 0 AND source = 'src1', false) AS outside FROM documents LEFT JOIN labels USING (doc_id))")
def label_audit(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.col("doc_id").cast("string")
    images = d.select(name.alias("filename"), F.sha2("text", 256).alias("sha256"), F.lit(60.0).alias("width"), F.lit(40.0).alias("height"))
    far = F.when(F.col("source") == "src1", 70.0).otherwise(50.0)
    point = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    shape = F.array(F.struct(F.lit("polygon").alias("shape_type"), F.array(point(F.lit(0.0), 0.0), point(far, 0.0), point(far, 30.0)).alias("points")))
    labels = table(spark, sf_dir, "labels").join(d.select("doc_id", "lang", "source"), "doc_id").select(
        name.alias("filename"), F.when(F.col("lang") == "fr", "other").otherwise(name).alias("image_path"), F.when(F.col("quality") == 0, 61.0).otherwise(60.0).alias("label_width"), F.lit(40.0).alias("label_height"),
        F.when(F.col("toxic") == 1, F.filter(shape, lambda s: F.lit(False))).otherwise(shape).alias("shapes"),
    )
    return C.label_audit(images, labels, table(spark, sf_dir, "benchmark").select(F.sha2("text", 256).alias("sha256")))


@query("""SELECT c_name AS source_path, CASE WHEN c_nationkey < 5 THEN 'wikimedia_commons' ELSE 'curated_source' END AS source_name,
(CASE WHEN c_acctbal < 0 THEN 'license_unknown' ELSE 'CC0' END) || '; ' || (CASE WHEN c_nationkey < 5 THEN 'https://wikimedia.org/x' WHEN c_nationkey > 20 THEN 'unknown_source' ELSE 'https://example.org' END) AS usage_permission,
CASE WHEN c_mktsegment = 'BUILDING' THEN 'low_light' ELSE 'normal_or_unknown' END AS lighting,
(CASE WHEN c_mktsegment = 'BUILDING' THEN 'Night view' WHEN c_mktsegment = 'MACHINERY' THEN c_name ELSE c_mktsegment END) || '; artist=' || (CASE WHEN c_custkey % 2 = 0 THEN 'unknown' ELSE 'someone' END) AS notes FROM customer""")
def provenance_rows(spark, sf_dir):
    k, m = F.col("c_nationkey"), F.col("c_mktsegment")
    rows = _customers(spark, sf_dir).select(
        F.col("c_name").alias("filename"), F.when(m == "BUILDING", "Night view").when(m == "MACHINERY", "  ").otherwise(m).alias("title"),
        F.when(k < 5, "https://wikimedia.org/x").when(k > 20, F.lit(None)).otherwise("https://example.org").alias("source"),
        F.when(F.col("c_acctbal") < 0, "").otherwise("CC0").alias("license"), F.when(F.col("c_custkey") % 2 != 0, "someone").alias("artist"),
    )
    return C.provenance(rows)


@query("SELECT c_name || '.JPG' AS filename, place, c_name || '.json' AS target, CAST(round_even(CAST(0.1 AS double) * (place + 1) * (c_nationkey + 100), 2) AS double) AS x, CAST(120 AS double) AS y FROM customer, (SELECT unnest([0, 1]) AS place)")
def seeded_shapes(spark, sf_dir):
    c = _customers(spark, sf_dir)
    images = c.select(F.concat("c_name", F.lit(".JPG")).alias("filename"), (F.col("c_nationkey") + 100).cast("double").alias("width"), F.lit(480.0).alias("height"))
    constants = images.select("filename", F.explode(F.array(F.lit(0), F.lit(1))).alias("place")).withColumn("points", F.array(F.struct((F.lit(0.1) * (F.col("place") + 1)).alias("x"), F.lit(0.25).alias("y"))))
    return C.seeded_shapes(constants, images, "tactile_paving").select("filename", "place", "target", F.col("points")[0]["x"].alias("x"), F.col("points")[0]["y"].alias("y"))


@query("SELECT s AS split, count(*) AS rows FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 10 < 7 THEN 'train' WHEN c_custkey % 10 = 7 THEN 'validation' ELSE 'test' END AS s FROM customer UNION ALL SELECT s_suppkey + 100000000, 'train' FROM supplier) GROUP BY s")
def merged_sets(spark, sf_dir):
    k = F.col("c_custkey")
    a = _customers(spark, sf_dir).select(k.alias("key"), F.when(k % 10 < 7, "train").when(k % 10 == 7, "validation").otherwise("test").alias("split"))
    b = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 100_000_000).alias("key"), F.lit("train").alias("split"))
    protected = table(spark, sf_dir, "orders").select((-1 - F.col("o_orderkey")).alias("key"))
    return M.value_counts(C.merged_sets([a, b], [True, True], "key", "split", protected), "split")


@query("SELECT user_id, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events WHERE event_type <> 'error' GROUP BY user_id")
def first_decodable(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    some = e.filter("value IS NOT NULL").select("user_id").distinct()
    return C.first_decodable(e.join(some, "user_id", "left_semi"), ["user_id"], "event_id", "value")


_MIX = """WITH p AS (SELECT CAST(p_partkey AS varchar) AS k, row_number() OVER (ORDER BY sha256('42:' || p_partkey), p_partkey) AS r, count(*) OVER () AS n FROM part),
t AS (SELECT k, CASE WHEN r <= greatest(1, round_even(0.1 * n, 0)) THEN 'val' ELSE 'train' END AS split FROM p),
s AS (SELECT CAST(s_suppkey AS varchar) AS k, row_number() OVER (ORDER BY sha256('42:' || s_suppkey), s_suppkey) - 1 AS r, count(*) OVER () AS m FROM supplier),
need AS (SELECT CAST(greatest(1, round_even(count(*) / 4.0, 0)) AS bigint) AS need FROM t WHERE split = 'train'),
x AS (SELECT split, 'public' AS source, k AS sample_id, 'public-' || k AS target_name FROM t
UNION ALL SELECT 'train', 'station', k, format('station-{:04d}-{}', place, k) FROM (SELECT CAST(unnest(range(need)) AS integer) AS place FROM need) JOIN s ON place % m = r
UNION ALL SELECT 'val', 'station', CAST(n_nationkey AS varchar), 'station-' || n_nationkey FROM nation)"""


def _mixture(spark, sf_dir):
    named = lambda t, c: table(spark, sf_dir, t).select(F.col(c).alias("sample_id"))
    return C.mixture_plan(named("part", "p_partkey"), named("supplier", "s_suppkey"), named("nation", "n_nationkey"), 4, "sample_id", 42)


@query(f"{_MIX} SELECT * FROM x")
def mixture_plan(spark, sf_dir):
    return _mixture(spark, sf_dir)


@query(f"{_MIX} SELECT split, source, count(*) AS rows FROM x GROUP BY ALL")
def mixture_export(spark, sf_dir):
    """Written as an export, then read back by split."""
    path = f"{shared_path(spark, 'mixture')}/out"
    sinks.export_mixture(_mixture(spark, sf_dir), path, {"dataset_version": "v3"}, "tactile_paving")
    return spark.read.parquet(f"{path}/labels").groupBy("split", F.col("line").alias("source")).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT split, CAST(vec_id AS varchar) AS sample_id, format('{} {:.6f} {:.6f} {:.6f} {:.6f}', label, (2 * vec_id % 50 + 30) / 400.0, 0.5, 0.15, 0.2) AS line FROM (SELECT *, CASE WHEN label < 5 THEN 'train' ELSE 'test' END AS split FROM embeddings)")
def label_export(spark, sf_dir):
    """Boxes as label lines, exported with their dataset file and manifest, then read back."""
    x = (2 * F.col("vec_id") % 50) / 2.0
    b = table(spark, sf_dir, "embeddings").select(F.when(F.col("label") < 5, "train").otherwise("test").alias("split"), F.col("vec_id").cast("string").alias("sample_id"), F.col("label").alias("class_id"), x.alias("x1"), F.lit(40).alias("y1"), (x + 30).alias("x2"), F.lit(60).alias("y2"), F.lit(200).alias("width"), F.lit(100).alias("height"))
    b = b.withColumn("x1", F.col("x1")).withColumn("x2", F.col("x2"))
    empty = b.limit(0).withColumn("points", F.expr("array(named_struct('x', 0D, 'y', 0D))"))
    path = f"{shared_path(spark, 'export')}/out"
    sinks.export_dataset(sinks.label_lines(b, empty), b.select("sample_id", "split"), path, {"object": ["a", "b"]}, {"dataset_version": "v1", "source_manifest_sha256": "x"})
    return spark.read.parquet(f"{path}/labels").select("split", F.col("sample_id").cast("string").alias("sample_id"), "line")


@query("SELECT lang, format('{{\"long\":{},\"short\":{}}}', count(*) FILTER (n_chars >= 1000), count(*) FILTER (n_chars < 1000)) AS counts FROM documents GROUP BY lang")
def report_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(F.col("n_chars") < 1000).alias("s"), F.count_if(F.col("n_chars") >= 1000).alias("l"))
    return sinks.report_rows(d.select("lang", F.create_map(F.lit("short"), "s", F.lit("long"), "l").alias("counts")), ["counts"])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def committed_version(spark, sf_dir):
    """Two versions of a table, read through the pointer, which names the second one."""
    root = shared_path(spark, "versions")
    n = table(spark, sf_dir, "nation")
    sinks.commit_versions({"nation": n.withColumn("n_name", F.lower("n_name")).filter("n_regionkey > 1")}, root)
    sinks.commit_versions({"nation": n}, root)
    version = spark.read.schema("version string").json(f"{root}/CURRENT").first()["version"]
    return spark.read.parquet(f"{root}/{version}/nation")


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'overdrawn' ELSE c_mktsegment END AS state, c_acctbal FROM customer UNION ALL SELECT -1 - s_suppkey, 'supplier', s_acctbal FROM supplier""")
def upserted_table(spark, sf_dir):
    """A table behind a log of commits: customers, then two upserts, of which the second one changes what the first one did."""
    root = shared_path(spark, "log")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("state"), "c_acctbal")
    commits.write_table(c, root, "c_custkey", buckets=8)
    over = c.filter("c_acctbal < 0")
    commits.upsert_table(over.withColumn("state", F.lit("first")), root)
    s = table(spark, sf_dir, "supplier").select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.lit("supplier").alias("state"), F.col("s_acctbal").alias("c_acctbal"))
    commits.upsert_table(over.withColumn("state", F.lit("overdrawn")).unionByName(s), root)
    return commits.read_table(spark, root)


_STATUS = "CASE WHEN quality IS NULL THEN 'unreviewed' ELSE 'provisional' END"


def _manifest(spark, sf_dir):
    """Documents as a seeded manifest into which labels are imported as provisional annotations."""
    d = R.seeded(table(spark, sf_dir, "documents").select("doc_id"), ["ground_truth"])
    a = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("string").alias("ground_truth"))
    return R.imported(d, a, "doc_id", "ground_truth")


@query(f"SELECT doc_id, coalesce(CAST(toxic AS varchar), '') AS ground_truth, {_STATUS} AS review_status, '' AS reviewer, '' AS reviewed_at, '' AS notes FROM documents LEFT JOIN labels USING (doc_id)")
def review_import(spark, sf_dir):
    return _manifest(spark, sf_dir)


@query(f"SELECT doc_id, CASE WHEN quality = 1 THEN 'human_reviewed' ELSE {_STATUS} END AS review_status, CASE WHEN quality = 1 THEN 'someone' ELSE '' END AS reviewer, CASE WHEN quality = 1 THEN '2024-05-01T10:00:00Z' ELSE '' END AS reviewed_at FROM documents LEFT JOIN labels USING (doc_id)")
def review_human(spark, sf_dir):
    keys = table(spark, sf_dir, "labels").filter("quality = 1")
    return R.mark_human_reviewed(_manifest(spark, sf_dir), keys, "doc_id", "someone", "2024-05-01T10:00:00Z").select("doc_id", "review_status", "reviewer", "reviewed_at")


@query(f"SELECT doc_id, CASE WHEN quality = 0 THEN 'ambiguous' ELSE {_STATUS} END AS review_status, CASE WHEN quality = 0 THEN 'blurred' ELSE '' END AS notes FROM documents LEFT JOIN labels USING (doc_id)")
def review_ambiguous(spark, sf_dir):
    keys = table(spark, sf_dir, "labels").filter("quality = 0")
    return R.mark_ambiguous(_manifest(spark, sf_dir), keys, "doc_id", "blurred").select("doc_id", "review_status", "notes")


@query("SELECT sample_id, arg_max(review_status, n) AS review_status, arg_max(source_sha256, n) AS source_sha256 FROM (SELECT CAST(doc_id AS varchar) AS sample_id, CASE WHEN quality = 1 THEN 'human_reviewed' ELSE 'ambiguous' END AS review_status, sha256(CAST(doc_id AS varchar)) AS source_sha256, 0 AS n FROM labels UNION ALL SELECT CAST(doc_id AS varchar), CASE WHEN n_chars > 900 THEN 'ambiguous' ELSE 'human_reviewed' END, sha256(text), 1 FROM documents) GROUP BY sample_id")
def review_upsert(spark, sf_dir):
    """Every document is reviewed twice, bound to its content; the later of both stands, in place of older reviews."""
    d = table(spark, sf_dir, "documents")
    old = _reviews(spark, sf_dir)
    status = lambda late: F.when((F.col("n_chars") > 900) if late else F.lit(True), R.AMBIGUOUS).otherwise(R.HUMAN_REVIEWED)
    change = lambda at, late: d.select(F.col("doc_id").cast("string").alias("sample_id"), F.lit("").alias("source_sha256"), F.lit("").alias("annotation_sha256"), status(late).alias("review_status"), F.lit("x").alias("reviewer"), F.lit(at).alias("reviewed_at"), F.lit("n").alias("notes"))
    changes = change("2024-06-01T10:00:00Z", False).unionByName(change("2024-06-02T10:00:00Z", True))
    samples = d.select(F.col("doc_id").cast("string").alias("sample_id"), F.sha2("text", 256).alias("source_sha256"))
    return R.upsert(old, R.bound_changes(changes, samples, "sample_id", ["source_sha256"]), "sample_id", "reviewed_at").select("sample_id", "review_status", "source_sha256")


@query("SELECT lang, CASE WHEN min(n_chars) < 20 THEN 1 WHEN count(l.doc_id) < count(*) THEN 2 ELSE 0 END AS exit_code FROM documents AS d LEFT JOIN labels AS l USING (doc_id) GROUP BY lang")
def exit_codes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "left")
    s = d.groupBy("lang").agg(F.count_if(F.col("n_chars") < 20).alias("invalid"), (F.count("l") == F.count(F.lit(1))).alias("ready"))
    return s.select("lang", R.exit_code("invalid", "ready").alias("exit_code"))


@query("""SELECT p_partkey, CASE WHEN p_size = 1 THEN ['missing_file', 'checksum'] WHEN p_size = 2 THEN ['empty_file'] WHEN p_size = 3 THEN ['checksum_line'] WHEN p_size = 4 THEN ['no_metrics'] WHEN p_size = 5 THEN ['dataset_version', 'bad_epochs'] WHEN p_size = 6 THEN ['task', 'labels'] WHEN p_size = 7 THEN ['version'] ELSE CAST([] AS varchar[]) END AS errors FROM part""")
def bundle_contract(spark, sf_dir):
    n = F.col("p_size")
    names = V.BUNDLE_FILES
    sizes = F.map_from_arrays(F.array(*(F.lit(x) for x in names)), F.array(*(F.when((n == 1) & (F.lit(x) == names[-1]), F.lit(None)).when((n == 2) & (F.lit(x) == names[0]), 0).otherwise(5).cast("long") for x in names)))
    config = F.create_map(F.lit("dataset_version"), F.when(n == 5, " ").otherwise("v1"), F.lit("seed"), F.lit("42"), F.lit("imgsz"), F.lit("640"), F.lit("epochs"), F.when(n == 5, "0").otherwise("80"), F.lit("version"), F.when(n == 7, "1").otherwise("2"))
    rows = table(spark, sf_dir, "part").select(
        "p_partkey", sizes.alias("files"), F.when(n == 3, "abc  best.pt more").otherwise("ABC  best.pt").alias("checksum_line"), F.when(n == 1, "def").otherwise("abc").alias("sha256"),
        F.when(n == 4, F.create_map().cast("map<string,double>")).otherwise(F.create_map(F.lit("recall"), F.lit(0.9))).alias("metrics"), config.alias("config"),
        F.when(n == 6, "detect").otherwise("segment").alias("task"), V.labels_equal(F.create_map(F.lit("0"), F.when(n == 6, "x").otherwise("tactile_paving")), F.create_map(F.lit(0), F.lit("tactile_paving"))).alias("labels_ok"),
    )
    return rows.select("p_partkey", V.all_errors(V.bundle_errors(version="2")).alias("errors"))


@query("SELECT s_suppkey, list_filter([CASE WHEN s_nationkey = 0 THEN 'dataset_version' END, CASE WHEN s_nationkey < 4 THEN 'checkpoint_name' END, CASE WHEN s_nationkey > 20 THEN 'checkpoint_folder' END, CASE WHEN s_acctbal < 0 THEN 'run_name' END, CASE WHEN s_nationkey = 7 THEN 'run_exists' END], lambda x: x IS NOT NULL) AS errors FROM supplier")
def config_contract(spark, sf_dir):
    n = F.col("s_nationkey")
    path = F.concat(F.when(n > 20, "x\\other\\").otherwise("x\\GuideSet\\"), F.when(n < 4, "best.pt").otherwise("start.pt"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(n == 0, "").otherwise("v1").alias("dataset_version"), path.alias("checkpoint"), F.when(F.col("s_acctbal") < 0, " ").otherwise("run").alias("run_name"), (n == 7).alias("run_exists"))
    return rows.select("s_suppkey", V.all_errors(V.config_errors("start.pt", "guideset")).alias("errors"))


@query("SELECT o_orderstatus, coalesce(CASE WHEN o_orderpriority LIKE '1%' THEN NULL WHEN o_orderpriority LIKE '2%' THEN 'v2' ELSE 'v1' END, 'v0') = 'v1' AS matches, count(*) AS rows FROM orders GROUP BY ALL")
def version_gate(spark, sf_dir):
    p = F.col("o_orderpriority")
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.when(p.startswith("2"), "v2").when(~p.startswith("1"), "v1").alias("validation"), F.lit("v0").alias("dataset"), F.lit("v1").alias("manifest"))
    return o.groupBy("o_orderstatus", V.version_matches("validation", "dataset", "manifest").alias("matches")).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def fail_fast(spark, sf_dir):
    """No row of the table breaks the rule; one that did would end the evaluation."""
    return V.require(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice") >= 0, "a price is negative")


@query("SELECT vec_id, CASE WHEN len(list_filter(v, lambda x: NOT isfinite(x))) > 0 THEN 'not_finite' WHEN len(list_filter(v, lambda x: x < -1 OR x > 1)) > 0 THEN 'out_of_range' END AS error FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS double) * 4) AS v FROM embeddings)")
def value_ranges(spark, sf_dir):
    """First fault of a whole vector: a value that isn't finite, then one that is out of range."""
    v = F.transform("embedding", lambda x: x.cast("double") * 4)
    far = F.exists(v, lambda x: (x < -1) | (x > 1))
    return table(spark, sf_dir, "embeddings").select("vec_id", V.first_error([("not_finite", ~F.forall(v, X.finite)), ("out_of_range", far)]).alias("error"))


@query("SELECT vec_id, p.place, x, y FROM (SELECT vec_id, unnest(range(len(embedding) // 2)) AS place, embedding FROM embeddings) AS p, LATERAL (SELECT CAST(embedding[place + 1] AS double) AS x, CAST(embedding[place + 1 + len(embedding) // 2] AS double) AS y)")
def positional_zip(spark, sf_dir):
    half = (F.size("embedding") / 2).cast("int")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", F.lit(1), half).alias("a"), F.slice("embedding", half + 1, half).alias("b"))
    return e.select("vec_id", F.posexplode(P.zipped("a", "b")).alias("place", "z")).select("vec_id", "place", F.col("z.a").cast("double").alias("x"), F.col("z.b").cast("double").alias("y"))


@query("SELECT s_suppkey, row_number() OVER (ORDER BY lower(upper(s_name)), s_suppkey) AS rank FROM supplier")
def casefold_order(spark, sf_dir):
    return S.ranked(table(spark, sf_dir, "supplier").select("s_suppkey", X.casefold("s_name").alias("k")), ["k", "s_suppkey"]).select("s_suppkey", "rank")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20")
def limit_or_fail(spark, sf_dir):
    """The limit is the operator's own."""
    return S.limit_or_fail(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", 20)


@query("SELECT page_id, CASE WHEN s = '' THEN 'image' ELSE substr(s, 1, 80) END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(list_last(string_split(url, '/')), '(.)\\.[^.]*$', '\\1'), '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS s FROM pages)")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.safe_stem("url").alias("name"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages")
def url_parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", X.url_part("url", "HOST").alias("host"), X.url_part("url", "PATH").alias("path"))


@query("SELECT o_orderkey, format('{:.6f}', round(CAST(o_totalprice / 7 AS decimal(38, 12)), 6)) AS text, CASE WHEN o_orderpriority LIKE '1%' THEN CAST(o_totalprice AS double) END AS parsed FROM orders")
def number_texts(spark, sf_dir):
    text = F.when(F.col("o_orderpriority").startswith("1"), F.col("o_totalprice").cast("string")).otherwise(F.concat(F.col("o_totalprice").cast("string"), F.lit("f")))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.fixed_point(F.col("o_totalprice") / 7).alias("text"), X.to_number(text).alias("parsed"))


@query("SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000000+00:00' AS at FROM orders")
def iso_times(spark, sf_dir):
    """The clock is a column here, so that both sides know it."""
    return table(spark, sf_dir, "orders").select(X.now_iso(F.col("o_orderdate").cast("timestamp")).alias("at")).distinct()


_BOX = "CAST(l_quantity AS double) AS x1, CAST(l_discount * 100 AS double) AS y1, CAST(l_quantity + 10 AS double) AS x2, CAST(l_discount * 100 + l_tax * 100 AS double) AS y2"
_ITEM = "l_orderkey, l_linenumber"


@query(f"SELECT {_ITEM}, (x1 + x2) / 2 / 100 AS cx, (y1 + y2) / 2 / 50 AS cy, (x2 - x1) / 100 AS w, (y2 - y1) / 50 AS h, CASE WHEN x1 < 0 OR y1 < 0 OR x2 > 58 OR y2 > 50 THEN 'outside' WHEN x1 >= x2 OR y1 >= y2 THEN 'empty' END AS error FROM (SELECT {_ITEM}, {_BOX} FROM lineitem)")
def box_geometry(spark, sf_dir):
    i = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("x1"), (F.col("l_discount") * 100).alias("y1"), (F.col("l_quantity") + 10).alias("x2"), (F.col("l_discount") * 100 + F.col("l_tax") * 100).alias("y2"))
    c = G.box_to_centre("x1", "y1", "x2", "y2", F.lit(100), F.lit(50))
    return i.select("l_orderkey", "l_linenumber", c.alias("c"), G.box_error("x1", "y1", "x2", "y2", F.lit(58.0), F.lit(50.0)).alias("error")).select("l_orderkey", "l_linenumber", "c.*", "error")


_PTS = "(SELECT vec_id, unnest(range(len(embedding) // 2)) AS k, embedding FROM embeddings)"


@query(f"SELECT vec_id, sum(nx) AS nx, sum(py) AS py, sum(gx) AS gx FROM (SELECT vec_id, CAST(embedding[2 * k + 1] AS double) / 640 AS nx, round_even(CAST(embedding[2 * k + 2] AS double) * 480, 2) AS py, greatest(0, least(round_even(CAST(embedding[2 * k + 1] AS double) * 64, 0), 9)) AS gx FROM {_PTS}) GROUP BY vec_id")
def point_scaling(spark, sf_dir):
    pairs = F.transform(F.sequence(F.lit(1), F.size("embedding") - 1, F.lit(2)), lambda k: F.struct(F.element_at("embedding", k).cast("double").alias("x"), F.element_at("embedding", k + 1).cast("double").alias("y")))
    e = table(spark, sf_dir, "embeddings").select("vec_id", pairs.alias("p"))
    total = lambda c, f: F.aggregate(c, F.lit(0.0), lambda s, q: s + q[f])
    big = F.transform("p", lambda q: F.struct((q["x"] * 64).alias("x"), (q["y"] * 64).alias("y")))
    return e.select("vec_id", total(G.normalised("p", F.lit(640), F.lit(480)), "x").alias("nx"), total(G.denormalised("p", F.lit(640), F.lit(480)), "y").alias("py"), total(G.clipped_to_grid(big, F.lit(10), F.lit(10)), "x").alias("gx"))


@query("SELECT vec_id, abs(x0 * y1 - x1 * y0 + x1 * y2 - x2 * y1 + x2 * y0 - x0 * y2) / 2 AS area FROM (SELECT vec_id, CAST(embedding[1] AS double) AS x0, CAST(embedding[2] AS double) AS y0, CAST(embedding[3] AS double) AS x1, CAST(embedding[4] AS double) AS y1, CAST(embedding[5] AS double) AS x2, CAST(embedding[6] AS double) AS y2 FROM embeddings)")
def float_areas(spark, sf_dir):
    v = lambda k: F.element_at("embedding", k).cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", G.float_area(F.array(*(F.struct(v(2 * k + 1).alias("x"), v(2 * k + 2).alias("y")) for k in range(3)))).alias("area"))


@query("SELECT vec_id, CASE WHEN u = 0 THEN 1.0 ELSE i / u END AS iou FROM (SELECT vec_id, len(list_filter(range(len(embedding) // 2), lambda k: embedding[k + 1] > 0.1 AND embedding[k + 1 + len(embedding) // 2] > 0.1)) AS i, len(list_filter(range(len(embedding) // 2), lambda k: embedding[k + 1] > 0.1 OR embedding[k + 1 + len(embedding) // 2] > 0.1)) AS u FROM embeddings)")
def mask_iou(spark, sf_dir):
    """The halves of each vector as truth and prediction."""
    half = (F.size("embedding") / 2).cast("int")
    mask = lambda a: F.transform(a, lambda v: (v > 0.1).cast("int"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", mask(F.slice("embedding", F.lit(1), half)).alias("t"), mask(F.slice("embedding", half + 1, half)).alias("p"))
    return e.select("vec_id", G.binary_iou("t", "p").alias("iou"))


def _inside(first: int, n: int) -> str:
    """SQL of the pixels (x, y) that a polygon of ``n`` points from value ``first`` of a vector on fills: centres inside of it, or within half a pixel of an edge."""
    at = lambda k: f"round_even(CAST(embedding[{first + 2 * (k % n)}] AS double) * 60 + 16, 0)", lambda k: f"round_even(CAST(embedding[{first + 2 * (k % n) + 1}] AS double) * 45 + 12, 0)"
    edges = ", ".join(f"{{'x1': {at[0](k)}, 'y1': {at[1](k)}, 'x2': {at[0](k + 1)}, 'y2': {at[1](k + 1)}}}" for k in range(n))
    crosses = "(e.y1 > y) <> (e.y2 > y) AND x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1"
    t = "least(greatest(((x - e.x1) * (e.x2 - e.x1) + (y - e.y1) * (e.y2 - e.y1)) / greatest((e.x2 - e.x1) * (e.x2 - e.x1) + (e.y2 - e.y1) * (e.y2 - e.y1), 1e-12), 0), 1)"
    near = f"greatest(abs(e.x1 + {t} * (e.x2 - e.x1) - x), abs(e.y1 + {t} * (e.y2 - e.y1) - y)) < 0.5"
    return f"(SELECT (count(*) FILTER ({crosses})) % 2 = 1 OR bool_or({near}) FROM (SELECT unnest([{edges}]) AS e))"


@query(f"""WITH p AS (SELECT vec_id, {_inside(1, 5)} AS a, {_inside(11, 7)} AS b FROM embeddings, (SELECT CAST(unnest(range(32)) AS double) AS x), (SELECT CAST(unnest(range(24)) AS double) AS y)),
n AS (SELECT vec_id, count(*) FILTER (a) AS n_a, count(*) FILTER (b) AS n_b, count(*) FILTER (a AND b) AS n_both, count(*) FILTER (a OR b) AS n_either FROM p GROUP BY vec_id)
SELECT *, CASE WHEN n_either = 0 THEN 1.0 ELSE n_both / n_either END AS iou, n_a / 768 AS coverage FROM n""")
def polygon_overlaps(spark, sf_dir):
    """Two polygons of any shape, also crossing themselves and leaving the grid, from the values of each vector: filled on a grid of 32 by 24 pixels as runs."""
    v = lambda k, scale, middle: F.rint(F.element_at("embedding", k).cast("double") * scale + middle)
    polygon = lambda first, n: F.array(F.array(*(F.struct(v(first + 2 * k, 60, 16).alias("x"), v(first + 2 * k + 1, 45, 12).alias("y")) for k in range(n))))
    e = table(spark, sf_dir, "embeddings").select("vec_id", MK.polygon_runs(polygon(1, 5), F.lit(32), F.lit(24)).alias("a"), MK.polygon_runs(polygon(11, 7), F.lit(32), F.lit(24)).alias("b"))
    return e.select("vec_id", MK.pixels("a").alias("n_a"), MK.pixels("b").alias("n_b"), MK.covered_pixels(["a", "b"], 2).alias("n_both"), MK.pixels(MK.union_runs(F.array("a", "b"))).alias("n_either"), MK.run_iou("a", "b").alias("iou"), MK.run_coverage("a", F.lit(768)).alias("coverage"))


@query("SELECT vec_id, list_filter(range(len(embedding)), lambda k: embedding[k + 1] >= 0.1) AS kept FROM embeddings")
def score_filter(spark, sf_dir):
    """Every value of a vector is the score of the polygon of its number."""
    numbers = F.sequence(F.lit(0).cast("long"), F.size("embedding").cast("long") - 1)
    e = table(spark, sf_dir, "embeddings").select("vec_id", numbers.alias("polygons"), F.transform("embedding", lambda v: v.cast("double")).alias("scores"))
    return e.select("vec_id", G.polygons_above("polygons", "scores", F.lit(0.1).cast("float").cast("double")).alias("kept"))


@query("SELECT s_suppkey, CAST((least(s_nationkey, 5) + 1) * 3 AS bigint) AS pixels FROM supplier")
def filled_rectangles(spark, sf_dir):
    """Rectangles filled on a 12 by 8 grid: a whole one of n + 1 by 3 pixels."""
    n = F.least(F.col("s_nationkey"), F.lit(5)).cast("double")
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    two, four = F.lit(2.0), F.lit(4.0)
    p = F.array(F.array(point(two, two), point(two + n, two), point(two + n, four), point(two, four)))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", polygon_mask(p, F.lit(12), F.lit(8)).alias("m"))
    return s.select("s_suppkey", F.aggregate("m", F.lit(0).cast("long"), lambda a, v: a + v).alias("pixels"))


@query("""SELECT vec_id, CAST(count(*) FILTER (r > l) AS bigint) AS ones, string_agg(CASE WHEN r > l THEN '1' ELSE '0' END, '' ORDER BY k) AS bits
FROM (SELECT vec_id, k, round_even(CAST(embedding[(k // 8 * 9 + k % 8 + 1) % 64 + 1] AS double) * 100, 0) AS r, round_even(CAST(embedding[(k // 8 * 9 + k % 8) % 64 + 1] AS double) * 100, 0) AS l
FROM (SELECT vec_id, unnest(range(64)) AS k, embedding FROM embeddings)) GROUP BY vec_id""")
def image_hash_ones(spark, sf_dir):
    """Vectors as images of 16 by 27 pixels, whose areas of 2 by 3 have the vector's values as their means: all bits of the hash."""
    cell = lambda r, c: F.element_at("embedding", ((r / 2).cast("int") * 9 + (c / 3).cast("int")) % 64 + 1).cast("double") * 100
    # Pixels of an area are as much above as below of its value.
    pixel = lambda i: cell((i / 27).cast("int"), i % 27) + (i % 3 - 1) * 8
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(16 * 27 - 1)), pixel).alias("pixels"))
    e = e.select("vec_id", image_difference_hash("pixels", F.lit(16), F.lit(27)).alias("hash"))
    return e.select("vec_id", F.bit_count("hash").cast("long").alias("ones"), F.lpad(F.bin("hash"), 64, "0").alias("bits"))


@query("SELECT label, avg(c) AS mean_coverage, max(c) AS max_coverage, count(*) FILTER (c > 0) AS frames_with_mask FROM (SELECT label, len(list_filter(embedding, lambda v: v > 0.2)) / len(embedding) AS c FROM embeddings) GROUP BY label")
def coverage_totals(spark, sf_dir):
    c = G.coverage(F.transform("embedding", lambda v: (v > F.lit(0.2)).cast("int")))
    e = table(spark, sf_dir, "embeddings").select("label", c.alias("c"))
    return e.groupBy("label").agg(F.avg("c").alias("mean_coverage"), F.max("c").alias("max_coverage"), F.count_if(F.col("c") > 0).alias("frames_with_mask"))


@query("""SELECT sha256(text) AS sample_id, CASE WHEN quality IS NULL THEN 0 ELSE 1 + toxic END AS n_shapes, CASE WHEN quality IS NULL THEN 'unreviewed' ELSE 'provisional' END AS review_status, CASE WHEN quality IS NULL THEN 0.0 ELSE 30.0 + coalesce(toxic * 5.0, 0) END AS widest,
source AS location_id, lang AS session_id, CASE WHEN lang = 'de' THEN 'wikimedia_commons' ELSE 'curated_source' END AS source_name, CASE WHEN source = 'src2' THEN 'low_light' ELSE 'normal_or_unknown' END AS lighting, 'static_photo' AS motion FROM documents LEFT JOIN labels USING (doc_id)""")
def photo_dataset(spark, sf_dir):
    """Documents as photos: those with labels have one or two shapes, the others an empty annotation that nobody has reviewed."""
    d = table(spark, sf_dir, "documents").withColumn("filename", F.col("doc_id").cast("string"))
    images = d.select("filename", F.sha2("text", 256).alias("sha256"), F.lit(60.0).alias("width"), F.lit(40.0).alias("height"))
    sources = d.select("filename", F.when(F.col("source") == "src2", "Night view").alias("title"), F.when(F.col("lang") == "de", "https://wikimedia.org/x").alias("source"), F.lit("CC0").alias("license"), F.lit(None).cast("string").alias("artist"))
    groups = d.select("filename", F.col("source").alias("location_id"), F.col("lang").alias("session_id"))
    point = lambda x, y: F.struct(x.alias("x"), F.lit(y).alias("y"))
    place = F.explode(F.sequence(F.lit(0), F.col("toxic").cast("int")))
    shapes = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("filename"), place.alias("place"))
    far = F.lit(30.0) + 5.0 * F.col("place")
    shapes = shapes.select("filename", "place", F.lit("paving").alias("label"), F.lit("polygon").alias("shape_type"), F.array(point(F.lit(0.0), 0.0), point(far, 0.0), point(far, 30.0)).alias("points"))
    annotations, metadata = C.labelled_dataset(sources, images, shapes, groups, ["paving"])
    widest = F.coalesce(F.array_max(F.flatten(F.transform("tactile", lambda t: F.transform(t["points"], lambda p: p["x"])))), F.lit(0.0))
    names = images.select("sha256", "filename").groupBy("filename").agg(F.min("sha256").alias("sample_id"))
    # Contents may repeat, so annotations are told apart by what they hold.
    key = annotations.select("sample_id", "n_shapes", "review_status", widest.alias("widest")).distinct()
    have = shapes.groupBy("filename").agg(F.count(F.lit(1)).cast("int").alias("n_shapes"))
    met = names.join(have, "filename", "left").withColumn("n_shapes", F.coalesce("n_shapes", F.lit(0)))
    out = met.join(key, ["sample_id", "n_shapes"]).join(metadata.withColumnRenamed("source_path", "filename"), "filename")
    return out.select("sample_id", "n_shapes", "review_status", "widest", "location_id", "session_id", "source_name", "lighting", "motion")
