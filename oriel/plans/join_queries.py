"""Queries: pairing, reconciliation, protected content, near duplicates, splits, selection, mixes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oriel.functions.hashing import assigned_split, content_hash, hash_bucket, seeded_key, text_difference_hash
from oriel.operators import dedup as D
from oriel.operators import metrics as M
from oriel.operators import pairing as P
from oriel.operators import select as S
from oriel.operators import validate as V
from oriel.plans.metric_queries import bucket_sql
from oriel.plans.registry import query, table
from oriel.plans.tables import written

NEAR = 5
_SPLIT = f"CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'validation' ELSE 'test' END"


@query("""SELECT k AS orderkey, n_left, n_right, CASE WHEN n_left > 1 OR n_right > 1 THEN 'duplicate' WHEN n_right = 0 THEN 'unmatched_left' WHEN n_left = 0 THEN 'unmatched_right' ELSE 'matched' END AS verdict
FROM (SELECT k, CAST(count(*) FILTER (s = 1) AS bigint) AS n_left, CAST(count(*) FILTER (s = 2) AS bigint) AS n_right FROM (SELECT o_orderkey AS k, 1 AS s FROM orders UNION ALL SELECT l_orderkey, 2 FROM lineitem) GROUP BY k)""")
def strict_one_to_one(spark, sf_dir):
    """Orders against all of their lines: those of one line match."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderkey"))
    return P.strict_one_to_one(o, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("orderkey")), "orderkey")


@query("""SELECT coalesce(a.k, b.k) AS key, CASE WHEN b.k IS NULL THEN 'missing' ELSE 'extra' END AS side FROM (SELECT DISTINCT s_suppkey AS k FROM supplier) AS a
FULL JOIN (SELECT DISTINCT n_nationkey AS k FROM nation) AS b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def set_reconcile(spark, sf_dir):
    """Numbers of suppliers against those of nations, which start at 0 and end earlier."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"))
    return P.reconcile(s, table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key")), "key")


@query("SELECT doc_id, coalesce(CASE WHEN quality = 1 THEN 'human_reviewed' WHEN quality = 0 THEN 'provisional' END, 'unreviewed') AS review_status FROM documents LEFT JOIN labels USING (doc_id)")
def left_default(spark, sf_dir):
    r = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "human_reviewed").otherwise("provisional").alias("review_status"))
    return P.left_default(table(spark, sf_dir, "documents").select("doc_id"), r, "doc_id", "review_status", "unreviewed")


@query("""SELECT doc_id, CASE WHEN r IS NULL THEN 'unreviewed' WHEN r = h THEN 'current' ELSE 'stale' END AS binding FROM (SELECT d.doc_id, sha256(text) AS h, CASE WHEN quality = 0 THEN sha256(text || chr(10)) WHEN quality = 1 THEN sha256(text) END AS r FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id)""")
def stale_review(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", content_hash("text").alias("source_sha256"), content_hash(F.concat("text", F.lit("\n"))).alias("other"))
    r = table(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", F.when(F.col("quality") == 0, F.col("other")).otherwise(F.col("source_sha256")).alias("source_sha256"))
    return P.binding_status(d.drop("other"), r, "doc_id", ["source_sha256"]).select("doc_id", "binding")


_NORMAL = "regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')"


@query("""SELECT doc_id FROM documents AS d ANTI JOIN (SELECT sha256(text) AS h FROM documents WHERE source = 'src0') AS p ON sha256(d.text) = p.h""")
def protected_exact(spark, sf_dir):
    """Documents whose content no document of a protected source has."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", content_hash("text").alias("sha256"))
    return P.without_protected(d, d.filter("source = 'src0'"), "sha256").select("doc_id")


@query("SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS first_member FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    return D.exact_groups(table(spark, sf_dir, "documents").select("doc_id", content_hash("text").alias("sha256")), "sha256", "doc_id")


@query("SELECT k AS custkey, count(*) AS occurrences FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey FROM supplier UNION ALL SELECT o_custkey FROM orders) GROUP BY k HAVING count(*) > 1")
def merge_conflicts(spark, sf_dir):
    keys = [table(spark, sf_dir, t).select(F.col(c).alias("custkey")) for t, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("orders", "o_custkey"))]
    return P.merge_conflicts(keys, "custkey")


@query("""SELECT k AS pair_key, u AS "user", a AS assistant, nu AS n_user, na AS n_assistant, CASE WHEN greatest(nu, na) > 1 THEN 'duplicate' WHEN least(nu, na) = 0 THEN 'unpaired' ELSE 'paired' END AS status
FROM (SELECT conv_id * 1000 + turn // 2 AS k, max(text) FILTER (role = 'user') AS u, max(text) FILTER (role = 'assistant') AS a, count(*) FILTER (role = 'user') AS nu, count(*) FILTER (role = 'assistant') AS na FROM conversations GROUP BY 1)""")
def role_pairing(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("pair_key", F.col("conv_id") * 1000 + F.floor(F.col("turn") / 2))
    return P.paired_roles(c, "pair_key", "role", "text", ["user", "assistant"])


#: Documents as tiny images: mean code points of 72 equal parts of the whole text, and the 64-bit difference hash of them.
_CELLS = "list_transform(range(72), lambda j: {'s': CAST(coalesce(list_sum(c[(j * n) // 72 + 1 : ((j + 1) * n) // 72]), 0) AS hugeint), 'k': greatest(((j + 1) * n) // 72 - (j * n) // 72, 1)})"
_BITS = " + ".join(f"CASE WHEN p[{k + 2}].s * p[{k + 1}].k > p[{k + 1}].s * p[{k + 2}].k THEN {1 << (63 - (r * 8 + x))}::hugeint ELSE 0 END" for r in range(8) for x in range(8) for k in [r * 9 + x])
_CODES = "(SELECT doc_id, lang, source, list_transform(string_split(text, ''), lambda x: unicode(x)) AS c FROM documents WHERE length(text) > 0)"
_HASHED = f"(SELECT doc_id AS idx, lang, source, CAST({_BITS} AS ubigint) AS h, {_SPLIT} AS split FROM (SELECT doc_id, lang, source, {_CELLS} AS p, {bucket_sql(1, 'CAST(doc_id AS varchar)')} AS b FROM (SELECT *, len(c) AS n FROM {_CODES})))"


def hashed(spark, sf_dir):
    """(idx, lang, source, hash, split): every document with its difference hash and a split by its id; hashes are made once."""
    d = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    return written(d.select(F.col("doc_id").alias("idx"), "lang", "source", text_difference_hash("text").alias("hash"), assigned_split(1, "doc_id").alias("split")), "hashed")


@query(f"""WITH d AS MATERIALIZED {_HASHED}, m AS (SELECT a.idx, min(b.idx) AS match_idx FROM d AS a JOIN d AS b ON b.idx < a.idx AND bit_count(xor(a.h, b.h)) <= {NEAR} GROUP BY a.idx)
SELECT m.idx, m.match_idx, CAST(bit_count(xor(a.h, b.h)) AS integer) AS distance FROM m JOIN d AS a ON a.idx = m.idx JOIN d AS b ON b.idx = m.match_idx""")
def near_dup_first(spark, sf_dir):
    return D.first_near(hashed(spark, sf_dir), NEAR).filter("match_idx IS NOT NULL").select("idx", "match_idx", "distance")


@query(f"WITH d AS MATERIALIZED {_HASHED} SELECT DISTINCT a.idx FROM d AS a JOIN (SELECT DISTINCT h FROM d WHERE source = 'src0') AS b ON bit_count(xor(a.h, b.h)) <= {NEAR} WHERE a.source <> 'src0'")
def near_protected(spark, sf_dir):
    d = hashed(spark, sf_dir)
    return D.near_any(d.filter("source <> 'src0'"), d.filter("source = 'src0'"), NEAR).select("idx")


@query(f"""WITH d AS MATERIALIZED {_HASHED}, m AS (SELECT a.idx, min(b.idx) AS match_idx FROM d AS a JOIN d AS b ON b.idx < a.idx AND a.split <> b.split AND bit_count(xor(a.h, b.h)) <= {NEAR} GROUP BY a.idx)
SELECT m.idx, m.match_idx, a.split, b.split AS match_split, CAST(bit_count(xor(a.h, b.h)) AS integer) AS distance FROM m JOIN d AS a ON a.idx = m.idx JOIN d AS b ON b.idx = m.match_idx""")
def split_leakage(spark, sf_dir):
    """All earlier rows are compared."""
    return D.split_leaks(hashed(spark, sf_dir), NEAR, mode="all_pairs")


@query(f"""WITH d AS MATERIALIZED {_HASHED}, m AS (SELECT a.idx, min(b.idx) AS match_idx FROM d AS a JOIN d AS b ON b.idx < a.idx AND bit_count(xor(a.h, b.h)) <= {NEAR} GROUP BY a.idx)
SELECT m.idx, m.match_idx, a.split, b.split AS match_split, CAST(bit_count(xor(a.h, b.h)) AS integer) AS distance FROM m JOIN d AS a ON a.idx = m.idx JOIN d AS b ON b.idx = m.match_idx WHERE a.split <> b.split""")
def split_leakage_first(spark, sf_dir):
    """Only each row's earliest match is looked at."""
    return D.split_leaks(hashed(spark, sf_dir), NEAR, mode="first_match")


@query(f"""WITH d AS MATERIALIZED {_HASHED}, c AS (SELECT idx, lang, source, split, h,
 CASE WHEN lang = 'es' THEN 'unsupported' WHEN source <> 'src0' AND h IN (SELECT h FROM d WHERE source = 'src0') THEN 'protected_exact' WHEN idx > min(idx) OVER (PARTITION BY h) THEN 'public_exact'
 WHEN source <> 'src0' AND EXISTS (SELECT 1 FROM d AS p WHERE p.source = 'src0' AND bit_count(xor(p.h, d.h)) <= {NEAR}) THEN 'protected_near' ELSE 'accepted' END AS reason FROM d)
SELECT reason, count(*) AS rows FROM c GROUP BY reason""")
def curation_waterfall(spark, sf_dir):
    d = hashed(spark, sf_dir)
    protected = d.filter("source = 'src0'")
    exact = protected.select("hash", F.lit(True).alias("_exact")).distinct()
    near = D.near_any(d.select("hash").distinct(), protected, NEAR).select("hash", F.lit(True).alias("_near"))
    first = d.groupBy("hash").agg(F.min("idx").alias("_first"))
    x = d.join(first, "hash").join(exact, "hash", "left").join(near, "hash", "left")
    public = F.col("source") != "src0"
    rules = [("unsupported", F.col("lang") == "es"), ("protected_exact", public & F.col("_exact")), ("public_exact", F.col("idx") > F.col("_first")), ("protected_near", public & F.col("_near"))]
    return V.reason_counts(V.waterfall(x, rules))


_PUBLIC = "source NOT IN ('src0', 'src1')"


@query(f"""WITH RECURSIVE a AS MATERIALIZED (SELECT h.idx, h.source, h.h, sha256(d.text) AS key, l.doc_id IS NOT NULL AS paired, coalesce(l.quality = 1, false) AS valid FROM {_HASHED} AS h JOIN documents AS d ON d.doc_id = h.idx LEFT JOIN labels AS l ON l.doc_id = h.idx),
p AS MATERIALIZED (SELECT * FROM a WHERE source = 'src0'), s AS MATERIALIZED (SELECT * FROM a WHERE source = 'src1'),
c AS MATERIALIZED (SELECT idx, h, key, row_number() OVER (ORDER BY sha256('9:' || CAST(idx AS varchar))) AS rank,
 CASE WHEN NOT paired THEN 'unpaired' WHEN NOT valid THEN 'invalid_pair' WHEN key IN (SELECT key FROM p) THEN 'protected_exact' WHEN key IN (SELECT key FROM s) THEN 'station_exact' END AS early,
 CASE WHEN EXISTS (SELECT 1 FROM p WHERE bit_count(xor(p.h, a.h)) <= {NEAR}) THEN 'protected_near' WHEN EXISTS (SELECT 1 FROM s WHERE bit_count(xor(s.h, a.h)) <= {NEAR}) THEN 'station_near' END AS near FROM a WHERE {_PUBLIC}),
e AS MATERIALIZED (SELECT x.rank AS a, list(y.rank) AS before FROM c AS x JOIN c AS y ON y.rank < x.rank AND bit_count(xor(x.h, y.h)) <= {NEAR} WHERE x.early IS NULL AND x.near IS NULL GROUP BY x.rank),
w AS (SELECT 0::bigint AS rank, CAST([] AS bigint[]) AS kept UNION ALL SELECT w.rank + 1, CASE WHEN c.early IS NULL AND c.near IS NULL AND (e.a IS NULL OR len(list_filter(e.before, lambda x: list_contains(w.kept, x))) = 0) THEN list_append(w.kept, w.rank + 1) ELSE w.kept END FROM w JOIN c ON c.rank = w.rank + 1 LEFT JOIN e ON e.a = w.rank + 1),
f AS (SELECT kept FROM w ORDER BY rank DESC LIMIT 1), k AS MATERIALIZED (SELECT c.rank, c.key FROM c, f WHERE list_contains(f.kept, c.rank))
SELECT idx, CASE WHEN early IS NOT NULL THEN early WHEN EXISTS (SELECT 1 FROM k WHERE k.key = c.key AND k.rank < c.rank) THEN 'public_exact' WHEN near IS NOT NULL THEN near WHEN rank IN (SELECT rank FROM k) THEN 'retained' ELSE 'public_near' END AS reason FROM c""")
def subset_waterfall(spark, sf_dir):
    """All reasons in order: labels are the other half of a pair, bad quality makes it invalid, two sources are protected and station content."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.sha2("text", 256).alias("key"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("idx"), F.lit(True).alias("paired"), (F.col("quality") == 1).alias("valid"))
    a = written(hashed(spark, sf_dir).join(d, "idx").join(labels, "idx", "left").withColumn("rank", seeded_key(9, "idx")), "subset")
    of = lambda s: a.filter(F.col("source") == s).select("key", "hash")
    return D.subset_reasons(a.filter(_PUBLIC), of("src0"), of("src1"), NEAR).select("idx", "reason")


@query(f"SELECT doc_id, CAST(b AS integer) AS bucket, {_SPLIT} AS split FROM (SELECT doc_id, {bucket_sql(42, 'lang', 'source')} AS b FROM documents)")
def hash_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", hash_bucket(42, "lang", "source").alias("bucket"), assigned_split(42, "lang", "source").alias("split"))


@query("SELECT p_partkey, sha256('7:' || CAST(p_partkey AS varchar)) AS order_key, row_number() OVER (ORDER BY sha256('7:' || CAST(p_partkey AS varchar))) AS rank FROM part")
def seeded_rank(spark, sf_dir):
    return S.ranked(S.seeded_order(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 7), ["order_key"])


_RANKED_PARTS = "(SELECT p_partkey, row_number() OVER (ORDER BY sha256('7:' || CAST(p_partkey AS varchar))) AS rank FROM part)"


@query(f"SELECT p_partkey, rank, CASE WHEN rank <= greatest(1, round_even(0.1 * (SELECT count(*) FROM part), 0)) THEN 'validation' ELSE 'train' END AS part FROM {_RANKED_PARTS}")
def holdout_head(spark, sf_dir):
    return S.holdout_head(seeded_rank(spark, sf_dir).select("p_partkey", "rank"))


@query("""WITH e AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS rank FROM supplier), n AS (SELECT count(*) AS n FROM part), m AS (SELECT count(*) AS m FROM supplier),
p AS (SELECT CAST(unnest(range(CAST(greatest(1, round_even(n / 4.0, 0)) AS bigint))) AS integer) AS place FROM n)
SELECT place, s_suppkey, rank, format('{:04d}_{}', place, s_suppkey) AS target_name FROM p, m JOIN e ON e.rank = p.place % m + 1""")
def ratio_mix(spark, sf_dir):
    extra = S.ranked(table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"])
    return S.ratio_mix(table(spark, sf_dir, "part").select("p_partkey"), extra, 4, "s_suppkey").select("place", "s_suppkey", "rank", "target_name")


_BUDGET, _MOST = 200_000, 50


@query(f"""WITH RECURSIVE r AS (SELECT doc_id, n_chars, k AS order_key, row_number() OVER (ORDER BY k) AS rank FROM (SELECT doc_id, n_chars, sha256('42:' || CAST(doc_id AS varchar)) AS k FROM documents)),
w AS (SELECT 0::bigint AS rank, 0::bigint AS used, 0::bigint AS taken, false AS ok UNION ALL SELECT r.rank, used + CASE WHEN used + n_chars <= {_BUDGET} AND taken < {_MOST} THEN n_chars ELSE 0 END, taken + CASE WHEN used + n_chars <= {_BUDGET} AND taken < {_MOST} THEN 1 ELSE 0 END, used + n_chars <= {_BUDGET} AND taken < {_MOST}
FROM w JOIN r ON r.rank = w.rank + 1) SELECT doc_id, n_chars, CAST(taken AS integer) AS take FROM w JOIN r USING (rank) WHERE ok""")
def budget_select(spark, sf_dir):
    d = S.seeded_order(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", 42)
    return S.budget_select(d, "order_key", "n_chars", _BUDGET, _MOST).select("doc_id", "n_chars", "take")


@query(f"""WITH RECURSIVE d AS MATERIALIZED (SELECT idx, h, row_number() OVER (ORDER BY idx) AS rank FROM {_HASHED}), e AS MATERIALIZED (SELECT a.rank AS a, list(b.rank) AS before FROM d AS a JOIN d AS b ON b.rank < a.rank AND bit_count(xor(a.h, b.h)) <= {NEAR} GROUP BY a.rank),
w AS (SELECT 0::bigint AS rank, CAST([] AS bigint[]) AS lost UNION ALL SELECT w.rank + 1, CASE WHEN e.a IS NOT NULL AND len(list_filter(e.before, lambda x: NOT list_contains(w.lost, x))) > 0 THEN list_append(w.lost, w.rank + 1) ELSE w.lost END FROM w LEFT JOIN e ON e.a = w.rank + 1 WHERE w.rank < (SELECT max(rank) FROM d)),
f AS (SELECT lost FROM w ORDER BY rank DESC LIMIT 1) SELECT idx, NOT list_contains(f.lost, d.rank) AS kept FROM d, f""")
def greedy_dedup(spark, sf_dir):
    return D.greedy_keep(hashed(spark, sf_dir).select("idx", "hash", F.col("idx").alias("rank")), NEAR).select("idx", "kept")


@query(f"""WITH RECURSIVE d AS MATERIALIZED (SELECT idx, h, row_number() OVER (ORDER BY idx) AS rank FROM {_HASHED}), e AS MATERIALIZED (SELECT a.rank AS a, list(b.rank) AS before FROM d AS a JOIN d AS b ON b.rank < a.rank AND bit_count(xor(a.h, b.h)) <= {NEAR} GROUP BY a.rank),
w AS (SELECT 0::bigint AS rank, CAST([] AS bigint[]) AS lost UNION ALL SELECT w.rank + 1, CASE WHEN e.a IS NOT NULL AND len(list_filter(e.before, lambda x: NOT list_contains(w.lost, x))) > 0 THEN list_append(w.lost, w.rank + 1) ELSE w.lost END FROM w LEFT JOIN e ON e.a = w.rank + 1 WHERE w.rank < (SELECT max(rank) FROM d)),
f AS (SELECT lost FROM w ORDER BY rank DESC LIMIT 1), k AS (SELECT d.idx, sum(CASE WHEN list_contains(f.lost, d.rank) THEN 0 ELSE 1 END) OVER (ORDER BY d.rank) AS n, NOT list_contains(f.lost, d.rank) AS kept FROM d, f) SELECT idx FROM k WHERE kept AND n <= 100""")
def greedy_retain_limit(spark, sf_dir):
    """The limit is the operator's own: retention stops at that many rows."""
    return D.greedy_keep(hashed(spark, sf_dir).select("idx", "hash", F.col("idx").alias("rank")), NEAR, limit=100).filter("kept").select("idx")


@query("SELECT s.lang, m.n AS rows FROM (SELECT DISTINCT lang FROM documents) AS s JOIN (SELECT lang, count(*) AS n FROM documents SEMI JOIN labels USING (doc_id) GROUP BY lang) AS m USING (lang)")
def labelled_semi(spark, sf_dir):
    return M.value_counts(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"), "lang")


@query("SELECT o_custkey, o_orderkey, n FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n > 3")
def skip_warmup(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("long").alias("n")).filter("n > 3")


@query("""SELECT p_brand, list_sort(list_filter(['ECONOMY', 'STANDARD', 'PROMO', 'SMALL', 'MEDIUM', 'LARGE'], lambda x: NOT list_contains(have, x))) AS missing, len(list_filter(['ECONOMY', 'STANDARD', 'PROMO', 'SMALL', 'MEDIUM', 'LARGE'], lambda x: NOT list_contains(have, x))) = 0 AS complete
FROM (SELECT p_brand, list(DISTINCT p_type) FILTER (p_size > 10) AS have FROM part GROUP BY p_brand)""")
def required_members(spark, sf_dir):
    """Which kinds each brand lacks among its larger parts."""
    large = F.when(F.col("p_size") > 10, F.col("p_type"))
    return P.missing_members(table(spark, sf_dir, "part").withColumn("large", large), ["p_brand"], "large", ["ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE"])
