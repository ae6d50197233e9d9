"""The thin queries over the text operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oriel.llm.common import table
from oriel.llm.decontaminate import decontaminate
from oriel.llm.html_text import extract_main_text
from oriel.llm.lines import line_dedup
from oriel.llm.mixing import mix
from oriel.llm.order_minhash import near_duplicate_classes
from oriel.llm.periodic import find_runs
from oriel.llm.pivot_index import top_k
from oriel.llm.quality import quality_rules
from oriel.llm.run_index import exact_dedup
from oriel.llm.spelling import spelling_groups
from oriel.llm.tokens import token_output
from oriel.llm.toxicity import score_toxicity
from oriel.llm.url_filter import filter_urls


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op3_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2("text", 256).alias("text_sha256"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op11_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_main_text": op2_main_text,
    "op3_run_index": op3_run_index,
    "op4_url_filter": op4_url_filter,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_mix_sources": op7_mix_sources,
    "op8_token_files": op8_token_files,
    "op9_line_dedup": op9_line_dedup,
    "op10_order_minhash": op10_order_minhash,
    "op11_pivot_search": op11_pivot_search,
    "op12_spelling_groups": op12_spelling_groups,
    "op13_periodic_runs": op13_periodic_runs,
}

_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: The unsigned crc32 of an ASCII or Latin text: a table of 256 rests, then a step for each byte.
_CRC_REST = "SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS bigint), CAST(range(8) AS bigint[])), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS rest"


def _crc(hexed: str) -> str:
    """SQL of the crc32 of bytes that stand as upper-case hexadecimal digits; the table of rests is ``rest``."""
    digit = "(strpos('0123456789ABCDEF', substr({h}, {k}, 1)) - 1)"
    byte = f"{digit.format(h=hexed, k='2 * i + 1')} * 16 + {digit.format(h=hexed, k='2 * i + 2')}"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(len({hexed}) // 2), lambda i: CAST({byte} AS bigint))), lambda x, y: xor(x // 256, rest[xor(x, y) % 256 + 1])))"


_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLE = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_FOLD}, ''), {_WORD}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(coalesce({_FOLD}, ''), {_WORD}) AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i + 1 : i + least(13, len(w))], ' ') AS t
       FROM b, unnest(range(greatest(len(w) - 12, 1))) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (SELECT doc_id, s.size, i, array_to_string(w[i + 1 : i + s.size], ' ') AS t
       FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size) AS s),
hit AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.t = bw.t),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS bigint) AS n_words, CAST(coalesce(n_hit, 0) AS bigint) AS n_hit, CAST(coalesce(n_items, 0) AS bigint) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_run_index": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, o, substr(h, 2 * o + 1, 910) AS c FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199, 256)) AS o FROM d WHERE len(h) >= 400)),
w AS (SELECT doc_id, o + i AS i, md5_number(substr(c, 2 * i + 1, 400)) AS t FROM (SELECT doc_id, o, c, unnest(range(len(c) // 2 - 199)) AS i FROM p)),
again AS (SELECT t FROM w GROUP BY t HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM w SEMI JOIN again USING (t)),
run AS (SELECT doc_id, i, sum(CASE WHEN i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM hit),
span AS (SELECT doc_id, k, min(i) AS first, max(i) + 200 AS stop FROM run GROUP BY doc_id, k),
gap AS (SELECT doc_id, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY k), 0) AS pos, first AS stop FROM span UNION ALL SELECT doc_id, max(stop), NULL FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(CASE WHEN stop IS NULL THEN substr(h, 2 * pos + 1) ELSE substr(h, 2 * pos + 1, 2 * (stop - pos)) END, '' ORDER BY pos) AS h FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(stop - first) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.h) // 2 AS bigint) AS n_bytes, CAST(coalesce(n_removed, 0) AS bigint) AS n_removed, CAST(coalesce(n_spans, 0) AS bigint) AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id)""",
    "op5_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT unnest([5, 8, 61]) AS size),
win AS (SELECT doc_id, size, i, array_to_string(w[i + 1 : i + size], ' ') AS t
        FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS i FROM d, k WHERE len(w) >= size)),
rep AS (SELECT doc_id, size, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, size, t) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, size, count(DISTINCT p) AS n FROM (SELECT doc_id, size, unnest(range(i, i + size)) AS p FROM rep) GROUP BY doc_id, size),
c AS (SELECT doc_id, coalesce(max(n) FILTER (WHERE size = 5), 0) AS n5, coalesce(max(n) FILTER (WHERE size = 8), 0) AS n8, count(*) FILTER (WHERE size = 61) > 0 AS far FROM cov GROUP BY doc_id),
l AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(dup.n, 0) AS n_dup_lines, coalesce(n5, 0) AS n_repeat_words, coalesce(n8, 0) AS n_covered, coalesce(far, false) AS far
      FROM d LEFT JOIN c USING (doc_id) LEFT JOIN dup USING (doc_id))
SELECT doc_id, CAST(n_words AS bigint) AS n_words, CAST(word_chars AS bigint) AS word_chars, CAST(n_symbols AS bigint) AS n_symbols, CAST(n_dup_lines AS bigint) AS n_dup_lines,
       CAST(n_repeat_words AS bigint) AS n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_covered <= 0.15 * n_words AND NOT far AS kept, CAST(n_covered AS bigint) AS n_covered
FROM m""",
    "op7_mix_sources": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS bigint) AS size, CAST('0x' || substr(md5(concat_ws(':', doc_id, text)), 1, 15) AS bigint) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS bigint) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS key FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][key % 3 + 1] AS double) AS weight, 2.0::double * source_size AS most, sum(source_size) OVER () * 1.5::double AS budget FROM s),
r AS (SELECT *, (budget - coalesce(sum(most) OVER earlier, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level FROM w
      WINDOW earlier AS (ORDER BY most / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT arg_min(level, (most / weight, key)) AS level FROM r WHERE most / weight >= level),
t AS (SELECT source, key, source_size, coalesce(least(most, lv.level * weight), most) AS target FROM r, lv),
q AS (SELECT *, least(CAST(round(target) AS bigint), 2 * source_size) AS quota, greatest(1, least(1048576, source_size // 1024)) AS block FROM t),
c AS (SELECT *, CAST(ceil(quota / block) AS bigint) AS n_slots FROM q),
e AS (SELECT *, CAST(sum(n_slots) OVER (ORDER BY key) AS bigint) AS stop, CAST(sum(n_slots) OVER () AS bigint) AS n FROM c),
g AS (SELECT n, (SELECT x FROM unnest(range(1, n + 1)) AS u(x) WHERE gcd(x, n) = 1 ORDER BY abs(x - greatest(1, round(n * (sqrt(5) - 1) / 2))), x LIMIT 1) AS step FROM (SELECT max(n) AS n FROM e)),
k AS (SELECT slot, (slot * step) % n AS point FROM g, unnest(range(n)) AS u(slot)),
sl AS (SELECT slot, key, row_number() OVER (PARTITION BY key ORDER BY slot) - 1 AS rank FROM k JOIN e ON point >= stop - n_slots AND point < stop),
a AS (SELECT d.doc_id, d.size, e.key, e.source_size, target, quota, block, CAST(sum(d.size) OVER (PARTITION BY e.key ORDER BY h, d.doc_id) AS bigint) - d.size AS pos FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
p AS (SELECT doc_id, key, size, quota, block, pos + x * source_size AS pos FROM a, unnest([0, 1]) AS u(x) WHERE size > 0),
o AS (SELECT doc_id, key, pos // block AS low, (least(pos + size, quota) - 1) // block AS high, least(pos + size, quota) - pos AS words FROM p WHERE pos < quota),
taken AS (SELECT doc_id, sum(words) AS taken FROM o GROUP BY doc_id),
first_slots AS (SELECT doc_id, min(slot) AS first_slot FROM o JOIN sl ON o.key = sl.key AND rank BETWEEN low AND high GROUP BY doc_id)
SELECT a.doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS bigint) AS taken, first_slot FROM a LEFT JOIN taken USING (doc_id) LEFT JOIN first_slots USING (doc_id)""",
    "op9_line_dedup": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, l[i + 1] || chr(10) || l[i + 2] || chr(10) || l[i + 3] AS t FROM (SELECT doc_id, l, unnest(range(len(l) - 2)) AS i FROM d WHERE len(l) >= 3)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM later),
starts AS (SELECT g.doc_id, count(*) AS n FROM gone AS g LEFT JOIN gone AS h ON g.doc_id = h.doc_id AND h.p = g.p - 1 WHERE h.p IS NULL GROUP BY g.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
rest AS (SELECT x.doc_id, string_agg(x.line, chr(10) ORDER BY x.p) AS text
         FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS p FROM d) AS x ANTI JOIN gone AS g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(coalesce(len(l), 0) AS bigint) AS n_lines, CAST(coalesce(n.n, 0) AS bigint) AS n_removed, CAST(coalesce(starts.n, 0) AS bigint) AS n_spans,
       CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(rest.text, '')) END AS text_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN starts USING (doc_id) LEFT JOIN rest USING (doc_id)""",
    "op11_pivot_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS double))) AS c FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.c, v.c) AS bigint) AS score FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(rank AS integer) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op12_spelling_groups": rf"""
WITH RECURSIVE t AS ({_CRC_REST}),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{6,}}')) AS run FROM documents) GROUP BY 1, 2),
h AS (SELECT run, n, {_crc("b")} AS h FROM (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS varchar), '') || ':' || run)) AS b FROM r), t),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS bigint) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, n FROM h) WHERE len(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
c AS MATERIALIZED (SELECT word, i, left(word, i) || substr(word, i + 2) AS cut FROM (SELECT word, unnest(range(len(word))) AS i FROM w)),
p AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT a.word AS a, b.word AS b FROM c AS a JOIN c AS b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word UNION ALL SELECT c.word, w.word FROM c JOIN w ON c.cut = w.word UNION ALL SELECT w.word, c.word FROM c JOIN w ON c.cut = w.word)),
k AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-w.n, b)) AS form, max(w.n) AS form_n FROM p JOIN w ON p.b = w.word GROUP BY a),
f AS MATERIALIZED (SELECT word, form, form_n FROM k JOIN w USING (word) WHERE form_n >= 5 * n),
e AS (SELECT word, form AS root, 1 AS step FROM f UNION ALL SELECT e.word, f.form, step + 1 FROM e JOIN f ON e.root = f.word)
SELECT w.word, f.form, coalesce(e.root, w.word) AS root, w.n, CAST(coalesce(n_near, 0) AS bigint) AS n_near, CAST(form_n AS bigint) AS form_n
FROM w LEFT JOIN (SELECT word, n_near FROM k) AS k USING (word) LEFT JOIN f USING (word) LEFT JOIN (SELECT word, arg_max(root, step) AS root FROM e GROUP BY word) AS e USING (word)""",
    "op13_periodic_runs": rf"""
WITH t AS ({_CRC_REST}),
o AS (SELECT doc_id, w, CAST(len(w) AS bigint) AS n, {_crc("b")} AS h FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-]+') AS w, hex(encode(CAST(doc_id AS varchar))) AS b FROM documents), t),
g AS (SELECT *, h % 10 = 0 AND n > 0 AS made, CASE WHEN n > 0 THEN (h // 10) % n END AS a, CASE WHEN n > 0 THEN 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) END AS p FROM o),
d AS MATERIALIZED (SELECT doc_id, n, CASE WHEN made THEN list_transform(range(n), lambda i: w[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) ELSE w END AS w FROM g),
win AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 16], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(n - 15)) AS i FROM d WHERE n >= 24)),
pr AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM win AS a JOIN win AS b ON a.doc_id = b.doc_id AND a.x = b.x AND a.i < b.i),
st AS (SELECT doc_id, q, min(i) AS start, max(i) + 16 + q - min(i) AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pr) GROUP BY doc_id, q, k),
big AS MATERIALIZED (SELECT * FROM st WHERE length >= greatest(24, 3 * q)),
run AS MATERIALIZED (SELECT * FROM big AS r WHERE NOT EXISTS (SELECT 1 FROM big AS s WHERE s.doc_id = r.doc_id AND s.q < r.q AND s.start <= r.start AND s.start + s.length >= r.start + r.length)),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM run),
kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS text FROM (SELECT doc_id, unnest(w) AS word, unnest(range(n)) AS i FROM d SEMI JOIN run USING (doc_id)) AS x ANTI JOIN gone USING (doc_id, i) GROUP BY x.doc_id),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS double) / q DESC, start, q) AS k, count(*) OVER (PARTITION BY doc_id) AS n_runs FROM run),
lines AS (SELECT doc_id, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS text FROM run GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(top.n_runs, 0) AS bigint) AS n_runs, CAST(top.start AS bigint) AS start, CAST(top.length AS bigint) AS length, CAST(top.q AS bigint) AS period, CAST(1000 * top.length // top.q AS bigint) AS exponent_milli,
       sha256(coalesce(lines.text, '')) AS runs_sha256, sha256(CASE WHEN top.doc_id IS NULL THEN array_to_string(d.w, ' ') ELSE coalesce(kept.text, '') END) AS collapsed_sha256
FROM d LEFT JOIN (SELECT * FROM top WHERE k = 1) AS top USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
