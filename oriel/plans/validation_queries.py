"""Queries: required fields, allow lists, paths, waterfalls, error lists, gates, masks and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from oriel.functions import expressions as X
from oriel.functions import geometry as G
from oriel.operators import review as R
from oriel.operators import validate as V
from oriel.plans.registry import query, table


@query(r"SELECT page_id, list_filter([CASE WHEN trim(coalesce(url, '')) = '' THEN 'url' END, CASE WHEN trim(coalesce(title, '')) = '' THEN 'title' END, CASE WHEN trim(coalesce(form, '')) = '' THEN 'form' END], lambda x: x IS NOT NULL) AS missing FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<form[^>]*>', 0) AS form FROM pages)")
def required_fields(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<form[^>]*>", 0).alias("form"))
    return p.select("page_id", V.missing_fields(["url", "title", "form"]).alias("missing"))


@query("SELECT lang, source IN ('src1', 'src2', 'src3') AND lang IN ('en', 'fr') AS allowed, count(*) AS rows FROM documents GROUP BY 1, 2")
def allow_list_filter(spark, sf_dir):
    ok = V.allowed({"source": ["src1", "src2", "src3"], "lang": ["en", "fr"]})
    return table(spark, sf_dir, "documents").groupBy("lang", ok.alias("allowed")).agg(F.count(F.lit(1)).alias("rows"))


_PATH = r"CASE WHEN page_id % 5 = 0 THEN '/' WHEN page_id % 7 = 0 THEN 'a/..' WHEN page_id % 11 = 0 THEN 'a\b' ELSE 'root' END || regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', '')"


@query(rf"""SELECT page_id, path, parts > 0 AND left(path, 1) <> '/' AND NOT contains(path, '\') AND NOT list_contains(string_split(path, '/'), '..') AS safe
FROM (SELECT page_id, path, len(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.'))) AS parts FROM (SELECT page_id, {_PATH} AS path FROM pages))""")
def path_safety(spark, sf_dir):
    head = F.when(F.col("page_id") % 5 == 0, "/").when(F.col("page_id") % 7 == 0, "a/..").when(F.col("page_id") % 11 == 0, "a\\b").otherwise("root")
    rest = F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), "[?#].*$", "")
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(head, rest).alias("path"))
    return p.select("page_id", "path", X.is_safe_path("path").alias("safe"))


@query("""SELECT page_id, CASE WHEN contains(u, 'casino') OR contains(u, 'bets') THEN 'gambling' WHEN contains(u, 'blog') THEN 'blog' WHEN contains(u, '.org') THEN 'organisation' ELSE 'other' END AS kind FROM (SELECT page_id, lower(url) AS u FROM pages)""")
def keyword_classify(spark, sf_dir):
    rules = [("gambling", ["casino", "bets"]), ("blog", ["blog"]), ("organisation", [".org"])]
    return table(spark, sf_dir, "pages").select("page_id", X.keyword_class("url", rules, "other").alias("kind"))


@query("""SELECT reason, count(*) AS rows FROM (SELECT CASE WHEN lang NOT IN ('en', 'fr', 'de') THEN 'unsupported' WHEN n_chars < 200 THEN 'too_short' WHEN n_chars > 10000 THEN 'too_long' WHEN contains(text, '|') THEN 'table' ELSE 'accepted' END AS reason FROM documents) GROUP BY reason""")
def reject_waterfall(spark, sf_dir):
    rules = [("unsupported", ~F.col("lang").isin("en", "fr", "de")), ("too_short", F.col("n_chars") < 200), ("too_long", F.col("n_chars") > 10000), ("table", F.col("text").contains("|"))]
    return V.reason_counts(V.waterfall(table(spark, sf_dir, "documents"), rules))


_ORDER_RULES = [("unknown_customer", "o_custkey % 50 = 0"), ("bad_status", "o_orderstatus NOT IN ('O', 'F')"), ("too_cheap", "o_totalprice < 20000"), ("bad_priority", "o_orderpriority LIKE '5%'")]


@query("""SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY n) AS integer) AS place, error FROM (
SELECT o_orderkey, 1 AS n, 'unknown_customer' AS error FROM orders WHERE o_custkey % 50 = 0 UNION ALL SELECT o_orderkey, 2, 'bad_status' FROM orders WHERE o_orderstatus NOT IN ('O', 'F')
UNION ALL SELECT o_orderkey, 3, 'too_cheap' FROM orders WHERE o_totalprice < 20000 UNION ALL SELECT o_orderkey, 4, 'bad_priority' FROM orders WHERE o_orderpriority LIKE '5%')""")
def validate_all_errors(spark, sf_dir):
    return V.exploded_errors(table(spark, sf_dir, "orders"), "o_orderkey", [(n, F.expr(c)) for n, c in _ORDER_RULES])


@query("""SELECT error, count(*) AS rows FROM (SELECT CASE WHEN o_custkey % 50 = 0 THEN 'unknown_customer' WHEN o_orderstatus NOT IN ('O', 'F') THEN 'bad_status' WHEN o_totalprice < 20000 THEN 'too_cheap' WHEN o_orderpriority LIKE '5%' THEN 'bad_priority' END AS error FROM orders) GROUP BY error""")
def validate_first_error(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(V.first_error([(n, F.expr(c)) for n, c in _ORDER_RULES]).alias("error"))
    return o.groupBy("error").agg(F.count(F.lit(1)).alias("rows"))


#: Documents as manifest rows: labelled ones are reviewed, of bad quality provisional; without a label incomplete.
_SUMMARY = """SELECT count(*) AS total_rows, count(*) FILTER (e = 0) AS valid_rows, count(*) FILTER (e > 0) AS invalid_rows, count(*) FILTER (quality = 1) AS human_reviewed_rows, count(*) FILTER (quality = 0) AS provisional_rows, count(*) FILTER (quality IS NULL) AS incomplete_rows
FROM (SELECT quality, (CASE WHEN n_chars < 50 THEN 1 ELSE 0 END) + (CASE WHEN trim(text) = '' THEN 1 ELSE 0 END) AS e FROM documents LEFT JOIN labels USING (doc_id))"""


def manifest_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    errors = V.all_errors([("short", F.col("n_chars") < 50), ("blank", X.is_blank("text"))])
    q = F.col("quality")
    return V.summary(d, errors, {"human_reviewed_rows": q == 1, "provisional_rows": q == 0, "incomplete_rows": q.isNull()})


@query(_SUMMARY)
def validation_summary(spark, sf_dir):
    return manifest_summary(spark, sf_dir)


@query(f"SELECT *, total_rows > 0 AND invalid_rows = 0 AND human_reviewed_rows = total_rows AS ready FROM ({_SUMMARY})")
def readiness_gate(spark, sf_dir):
    return V.readiness(manifest_summary(spark, sf_dir), "total_rows", "invalid_rows", "human_reviewed_rows")


@query(f"SELECT *, CASE WHEN total_rows = 0 THEN 'empty' WHEN invalid_rows > 0 THEN 'invalid' WHEN incomplete_rows > 0 THEN 'incomplete' WHEN provisional_rows > 0 THEN 'provisional' ELSE 'ready' END AS verdict FROM ({_SUMMARY})")
def manifest_gate(spark, sf_dir):
    return V.manifest_gate(manifest_summary(spark, sf_dir))


@query("""SELECT vec_id, list_filter([CASE WHEN len(m) <> 64 THEN 'size' END, CASE WHEN NOT list_bool_and(list_transform(m, lambda v: v IN (0, 255))) THEN 'values' END, CASE WHEN positive AND NOT list_bool_or(list_transform(m, lambda v: v <> 0)) THEN 'positive_empty' END, CASE WHEN NOT positive AND list_bool_or(list_transform(m, lambda v: v <> 0)) THEN 'negative_filled' END], lambda x: x IS NOT NULL) AS errors
FROM (SELECT vec_id, label % 2 = 0 AS positive, list_transform(list_filter(embedding, lambda v: v < 0.3 OR label <> 3), lambda v: CASE WHEN v > 0.3 THEN 255 WHEN v < -0.38 THEN 1 ELSE 0 END) AS m FROM embeddings)""")
def mask_rules(spark, sf_dir):
    """Whole vectors as masks of 8 by 8; vectors of one label lose large values, and so have the wrong size."""
    whole = F.filter("embedding", lambda v: (v < F.lit(0.3)) | (F.col("label") != 3))
    mask = F.transform(whole, lambda v: F.when(v > F.lit(0.3), 255).when(v < F.lit(-0.38), 1).otherwise(0))
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 2 == 0).alias("positive"), mask.alias("m"))
    rules = [
        ("size", F.size("m") != 64),
        ("values", F.size(F.array_except("m", F.array(F.lit(0), F.lit(255)))) > 0),
        ("positive_empty", F.col("positive") & ~G.is_present("m")),
        ("negative_filled", ~F.col("positive") & G.is_present("m")),
    ]
    return e.select("vec_id", V.all_errors(rules).alias("errors"))


@query("""SELECT vec_id, CASE WHEN list_min(v) < 10 OR list_max(v) > 70 THEN 'outside' WHEN area <= 0 THEN 'no_area' END AS error, area
FROM (SELECT vec_id, v, abs(list_sum(list_transform(range(n), lambda i: v[2 * i + 1] * v[2 * ((i + 1) % n) + 2] - v[2 * ((i + 1) % n) + 1] * v[2 * i + 2]))) / 2 AS area
FROM (SELECT vec_id, len(embedding) // 2 AS n, list_transform(embedding, lambda x: CAST(x AS double) * 50 + 40) AS v FROM embeddings))""")
def geometry_validation(spark, sf_dir):
    """All values of a vector as the corners of one polygon."""
    v = lambda k: F.element_at("embedding", k).cast("double") * 50 + 40
    corners = F.sequence(F.lit(0), (F.size("embedding") / 2).cast("int") - 1)
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(corners, lambda k: F.struct(v(2 * k + 1).alias("x"), v(2 * k + 2).alias("y"))).alias("points"))
    shifted = F.transform("points", lambda q: F.struct((q["x"] - 10).alias("x"), (q["y"] - 10).alias("y")))
    return e.select("vec_id", G.polygon_error(shifted, F.lit(60.0), F.lit(60.0)).alias("error"), G.shoelace_area("points").alias("area"))


@query("""SELECT doc_id, list_filter([CASE WHEN s = 'human_reviewed' AND who = '' THEN 'reviewer_required' END, CASE WHEN s = 'human_reviewed' AND NOT regexp_matches(at_, '(Z|[+-][0-9]{2}:?[0-9]{2})$') THEN 'zoned_time_required' END,
CASE WHEN s = 'provisional' AND (who <> '' OR at_ <> '') THEN 'provisional_has_reviewer' END, CASE WHEN s = 'ambiguous' AND note = '' THEN 'notes_required' END], lambda x: x IS NOT NULL) AS errors FROM (
SELECT doc_id, CASE WHEN quality = 1 AND doc_id % 9 > 0 THEN 'human_reviewed' WHEN quality = 1 THEN 'ambiguous' ELSE 'provisional' END AS s, CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'reviewer' END AS who, CASE WHEN doc_id % 3 = 0 THEN '2024-05-01T10:00:00Z' WHEN doc_id % 3 = 1 THEN '2024-05-01T10:00:00' ELSE '' END AS at_, CASE WHEN toxic = 1 THEN 'note' ELSE '' END AS note FROM labels)""")
def review_state(spark, sf_dir):
    i = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select(
        "doc_id",
        F.when((F.col("quality") == 1) & (i % 9 > 0), R.HUMAN_REVIEWED).when(F.col("quality") == 1, R.AMBIGUOUS).otherwise(R.PROVISIONAL).alias("review_status"),
        F.when(i % 4 == 0, "").otherwise("reviewer").alias("reviewer"),
        F.when(i % 3 == 0, "2024-05-01T10:00:00Z").when(i % 3 == 1, "2024-05-01T10:00:00").otherwise("").alias("reviewed_at"),
        F.when(F.col("toxic") == 1, "note").otherwise("").alias("notes"),
    )
    return rows.select("doc_id", V.all_errors(R.review_errors()).alias("errors"))


@query("""SELECT p_brand, list_sort(list_filter(['ECONOMY', 'STANDARD', 'PROMO', 'SMALL', 'MEDIUM', 'LARGE'], lambda x: NOT list_contains(have, x))) AS missing, empty_sizes FROM (SELECT p_brand, list(DISTINCT p_type) AS have, count(*) FILTER (p_size <= 2) AS empty_sizes FROM part GROUP BY p_brand)""")
def required_set(spark, sf_dir):
    required = F.array(*(F.lit(x) for x in ("ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE")))
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.collect_set("p_type").alias("have"), F.count_if(F.col("p_size") <= 2).alias("empty_sizes"))
    return p.select("p_brand", F.array_sort(F.array_except(required, "have")).alias("missing"), "empty_sizes")


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN 'missing' WHEN toxic = 1 THEN 'size' WHEN quality = 0 THEN 'hash' ELSE 'ok' END AS pin FROM documents LEFT JOIN labels USING (doc_id)""")
def artifact_pin(spark, sf_dir):
    """Labelled documents have pins: of a wrong size if toxic, of a wrong hash if their quality is bad."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("hash"), F.sha2(F.concat("text", F.lit(" ")), 256).alias("other"))
    p = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    pins = p.select("doc_id", (F.col("size") + F.col("toxic")).alias("size"), F.upper(F.when(F.col("quality") == 0, F.col("other")).otherwise(F.col("hash"))).alias("hash"))
    return V.pinned(d.drop("other"), pins, "doc_id", "size", "hash").select("doc_id", "pin")
