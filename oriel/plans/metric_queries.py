"""Queries: confusion counts, thresholds, overlap, timings and grouped counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from oriel.functions import geometry as G
from oriel.functions.hashing import assigned_split
from oriel.operators import metrics as M
from oriel.operators import select as S
from oriel.operators import validate as V
from oriel.plans.registry import query, table

THRESHOLDS = [0.05, 0.10, 0.15, 0.25]

#: Labelled documents: truth is the quality label, prediction a length of 1,000 characters.
_PRESENCE = "SELECT quality = 1 AS t, n_chars >= 1000 AS p, lang FROM labels JOIN documents USING (doc_id)"
_COUNTS = "CAST(count(*) FILTER (t AND p) AS bigint) AS tp, CAST(count(*) FILTER (NOT t AND p) AS bigint) AS fp, CAST(count(*) FILTER (t AND NOT p) AS bigint) AS fn, CAST(count(*) FILTER (NOT t AND NOT p) AS bigint) AS tn"
_HASH_SPLIT = "CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'validation' ELSE 'test' END"


def bucket_sql(seed: int, *parts: str) -> str:
    text = " || ':' || ".join([f"'{seed}'", *parts])
    return f"CAST(CAST(('0x' || substr(sha256({text}), 1, 16)) AS ubigint) % 100 AS integer)"


def presence(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id").select((F.col("quality") == 1).alias("t"), (F.col("n_chars") >= 1000).alias("p"), "lang", "doc_id")


@query(f"""WITH c AS (SELECT {_COUNTS} FROM ({_PRESENCE})), r AS (SELECT *, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM c)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) WHEN precision = 0 AND recall = 0 THEN 0.0 END AS f1 FROM r""")
def presence_metrics(spark, sf_dir):
    return M.presence_metrics(presence(spark, sf_dir), "t", "p")


@query(f"WITH c AS (SELECT lang, {_COUNTS} FROM ({_PRESENCE}) GROUP BY lang) SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, fp / nullif(fp + tn, 0) AS false_positive_rate FROM c")
def presence_fpr(spark, sf_dir):
    return M.presence_with_fpr(presence(spark, sf_dir), "t", "p", by=["lang"])


@query("SELECT doc_id, CASE WHEN t AND p THEN 'TP' WHEN p THEN 'FP' WHEN t THEN 'FN' ELSE 'TN' END AS outcome FROM (SELECT doc_id, quality = 1 AS t, n_chars >= 1000 AS p FROM labels JOIN documents USING (doc_id))")
def outcome_label(spark, sf_dir):
    return presence(spark, sf_dir).select("doc_id", M.outcome("t", "p").alias("outcome"))


@query(f"SELECT {_HASH_SPLIT} AS split, lang, count(*) AS rows FROM (SELECT lang, {bucket_sql(42, 'lang', 'source')} AS b FROM documents) GROUP BY 1, 2")
def count_by_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", assigned_split(42, "lang", "source").alias("split"))
    return M.value_counts(d, "split", "lang")


@query("""SELECT field, value, count(*) AS rows FROM (SELECT 'lang' AS field, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents
UNION ALL SELECT 'length', CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 5000 THEN 'medium' ELSE 'long' END FROM documents) GROUP BY ALL""")
def condition_counts(spark, sf_dir):
    length = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long")
    return M.independent_counts(table(spark, sf_dir, "documents").select("lang", "source", length.alias("length")), ["lang", "source", "length"])


@query(f"SELECT list_sort(list(DISTINCT {_HASH_SPLIT})) AS splits, count(DISTINCT {_HASH_SPLIT}) = 3 AS complete FROM (SELECT {bucket_sql(42, 'lang', 'source')} AS b FROM documents)")
def split_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(assigned_split(42, "lang", "source").alias("split"))
    return d.agg(F.array_sort(F.collect_set("split")).alias("splits")).withColumn("complete", F.col("splits") == F.array(F.lit("test"), F.lit("train"), F.lit("validation")))


#: Embeddings as predictions: truth from the label, score and overlap from components and signs.
_SCORES = """SELECT label % 2 = 0 AS t, abs(e[1]) AS score, i / nullif(u, 0) AS iou FROM (SELECT label, embedding AS e,
CAST(len(list_filter(range(1, 33), lambda k: embedding[k] > 0 AND embedding[k + 32] > 0)) AS double) AS i, CAST(len(list_filter(range(1, 33), lambda k: embedding[k] > 0 OR embedding[k + 32] > 0)) AS double) AS u FROM embeddings)"""
_REPORTS = f"""SELECT threshold, {_COUNTS}, avg(CASE WHEN t THEN CASE WHEN p THEN iou ELSE 0.0 END END) AS mean_iou FROM (SELECT *, score >= threshold AS p FROM ({_SCORES}), (SELECT unnest([0.05, 0.10, 0.15, 0.25])::double AS threshold)) GROUP BY threshold"""
_SWEEP = f"SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, fp / nullif(fp + tn, 0) AS false_positive_rate FROM ({_REPORTS})"


def scored(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    bits = lambda first: F.transform(F.slice("embedding", first, 32), lambda v: (v > 0).cast("int"))
    return e.select("vec_id", (F.col("label") % 2 == 0).alias("t"), F.abs(F.element_at("embedding", 1)).cast("double").alias("score"), G.binary_iou(bits(1), bits(33)).alias("iou"))


@query(_SWEEP)
def threshold_sweep(spark, sf_dir):
    return M.threshold_reports(scored(spark, sf_dir), THRESHOLDS, "t", "score", "iou")


@query(f"SELECT * FROM ({_SWEEP}) ORDER BY coalesce(recall, -1) DESC, coalesce(mean_iou, -1) DESC, coalesce(false_positive_rate, 1.0), threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    return S.best_threshold(threshold_sweep(spark, sf_dir))


@query(f"SELECT count(*) FILTER (t) AS positives, avg(iou) FILTER (t) AS mean_iou FROM ({_SCORES})")
def mean_iou(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.count_if("t").alias("positives"), M.mean_iou("t", "iou").alias("mean_iou"))


@query("""SELECT lang, recall, mean_length, coalesce(recall >= 0.90 AND mean_length >= 0.75, false) AS deployable FROM
(SELECT lang, count(*) FILTER (quality = 1 AND n_chars >= 1000) / nullif(count(*) FILTER (quality = 1), 0) AS recall, avg(least(1.0, n_chars / 1000.0)) FILTER (quality = 1) AS mean_length FROM labels JOIN documents USING (doc_id) GROUP BY lang)""")
def deployment_gate(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    good = F.col("quality") == 1
    by = d.groupBy("lang").agg(
        F.try_divide(F.count_if(good & (F.col("n_chars") >= 1000)).cast("double"), F.count_if(good).cast("double")).alias("recall"),
        F.avg(F.when(good, F.least(F.lit(1.0), F.col("n_chars") / 1000.0))).alias("mean_length"),
    )
    return by.withColumn("deployable", V.deployment_gate("recall", "mean_length"))


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50_ms, quantile_cont(value, 0.95) AS p95_ms, quantile_cont(value, 0.99) AS p99_ms FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return M.exact_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99})


@query("SELECT n, mean_ms, p50_ms, p95_ms, max_ms, 1000.0 / mean_ms AS rate FROM (SELECT count(value) AS n, avg(value) AS mean_ms, quantile_cont(value, 0.5) AS p50_ms, quantile_cont(value, 0.95) AS p95_ms, max(value) AS max_ms FROM events)")
def timing_summary(spark, sf_dir):
    return M.timing_summary(table(spark, sf_dir, "events"), "value")


@query("SELECT event_type, median(value) AS median_ms FROM events GROUP BY event_type")
def median_latency(spark, sf_dir):
    return M.exact_percentiles(table(spark, sf_dir, "events"), ["event_type"], "value", {"median_ms": 0.5})


@query("SELECT coalesce(max(value) FILTER (event_type = 'no such type'), 0.0) AS peak_missing, coalesce(max(value), 0.0) AS peak FROM events")
def peak_or_default(spark, sf_dir):
    v = F.when(F.col("event_type") == "no such type", F.col("value"))
    return table(spark, sf_dir, "events").agg(M.max_or(v).alias("peak_missing"), M.max_or("value").alias("peak"))


@query("SELECT class, sum(n) AS rows FROM (SELECT event_type AS class, 1 AS n FROM events UNION ALL SELECT 'user' || CAST(user_id % 7 AS varchar), 2 FROM events) GROUP BY class")
def class_counts(spark, sf_dir):
    counts = F.map_from_arrays(F.array(F.col("event_type"), F.concat(F.lit("user"), (F.col("user_id") % 7).cast("string"))), F.array(F.lit(1), F.lit(2)))
    return M.map_totals(table(spark, sf_dir, "events").select(counts.alias("counts")), "counts")


@query("SELECT lang, CAST(sum(n_chars) AS bigint) AS total_chars, CAST(sum(octet_length(encode(text))) AS bigint) AS total_bytes, max(n_chars) AS largest FROM documents GROUP BY lang")
def size_totals(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum("n_chars").alias("total_chars"), F.sum(F.octet_length("text").cast("long")).alias("total_bytes"), F.max("n_chars").alias("largest"))


@query("""SELECT vec_id, CAST(n AS integer) AS pixels, n / 16.0 AS coverage, n > 0 AS present FROM (SELECT vec_id, len(list_filter(range(1, 17), lambda k: embedding[k] > 0.1 OR embedding[k + 16] > 0.1 OR embedding[k + 32] > 0.1 OR embedding[k + 48] > 0.1)) AS n FROM embeddings)""")
def mask_coverage(spark, sf_dir):
    masks = F.array(*(F.slice("embedding", 1 + 16 * k, 16) for k in range(4)))
    e = table(spark, sf_dir, "embeddings").select("vec_id", G.union_mask(masks, 16, 0.1).alias("mask"))
    return e.select("vec_id", F.size(F.filter("mask", lambda v: v != 0)).alias("pixels"), G.coverage("mask").alias("coverage"), G.is_present("mask").alias("present"))


@query("SELECT event_type, CASE WHEN bool_or(coalesce(value > 100, true)) THEN 1 ELSE 0 END AS exit_code FROM events GROUP BY event_type")
def batch_status(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(M.any_failed(F.col("value") > 100).alias("exit_code"))


@query("""SELECT CASE WHEN s = 'error' OR v > 90 THEN 'failure' WHEN s = 'click' THEN 'obstacle' ELSE 'uncertain' END AS status, count(*) AS rows FROM (SELECT event_type AS s, value AS v FROM events) GROUP BY 1""")
def combined_status_counts(spark, sf_dir):
    status = V.frame_status(F.when(F.col("event_type") == "click", 1).otherwise(0))
    e = table(spark, sf_dir, "events").select(V.combined_status(status, (F.col("event_type") == "error") | (F.col("value") > 90)).alias("status"))
    return M.value_counts(e, "status")


@query("""SELECT inside, count(*) AS rows FROM (SELECT x, y, y >= 450 AND y <= 1000 AND (x - 100) * -550 - (y - 1000) * 280 <= 0 AND (x - 900) * -550 - (y - 1000) * -280 >= 0 AS inside
FROM (SELECT (l_quantity * 20 + l_quantity * 20 + 100 * l_discount) / 2.0 AS x, CAST(l_tax * 12500 AS double) AS y FROM lineitem)) GROUP BY inside""")
def corridor_hits(spark, sf_dir):
    x1 = F.col("l_quantity") * 20
    hit = G.in_corridor(x1, F.lit(0.0), x1 + 100 * F.col("l_discount"), F.col("l_tax") * 12500, F.lit(1000), F.lit(1000))
    return table(spark, sf_dir, "lineitem").select(hit.alias("inside")).groupBy("inside").agg(F.count(F.lit(1)).alias("rows"))
