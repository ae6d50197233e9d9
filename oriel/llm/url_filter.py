"""URL filters: fixed rules first, then naive Bayes over segmented host and path tokens."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oriel.llm.common import spread_join, with_row_key, written

#: The rules, as host and path, and their verdicts.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Words of hosts that hold nothing worth reading, known before anything is learnt.
SEED_BLOCK = "ads adult bet bets bonus casino cheap click crypto escort farm free gamble loan lottery pills poker porn promo sale seo sex spam track tracker viagra win xxx".split()
SEED_WEIGHT = 20

#: What each letter of a word that the corpus doesn't hold costs, beside the cost of the rarest word.
UNKNOWN_LETTER = 2.3
#: Weights are summed as whole millionths, so that sums don't depend on their order.
SCALE = 1_000_000

TAG = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1|<[^>]*+>", re.S | re.I)
LETTERS = re.compile(r"[a-z]+")
#: Labels that say nothing about a host.
PLAIN_LABELS = ("www", "com", "net", "org", "example")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column: what follows the first ``://`` up to ``?``, ``#`` or the end;
    both empty if there is none."""
    at = F.instr(url, "://")
    rest = F.regexp_replace(F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise(""), r"(?s)[?#].*", "")
    rest = F.coalesce(rest, F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return F.translate(host, UPPER, UPPER.lower()), F.substr(rest, F.length(host) + 1)


def matching_rule(host: str, path: str, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits a host, or one of its parent domains, and the start of the path, and its verdict;
    nulls if none does."""
    name = verdict = F.lit(None).cast("string")
    for rule, said in sorted(rules, key=lambda r: len(r[0])):
        domain, slash, start = rule.partition("/")
        fits = ((F.col(host) == domain) | F.col(host).endswith("." + domain)) & F.col(path).startswith(slash + start)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, said).otherwise(verdict)
    return name, verdict


def url_pieces(host: str, path: str) -> Column:
    """Runs of letters and runs of digits of a host's labels (``h:``) and of the path (``p:``); digits are ``0``."""
    labels = F.filter(F.regexp_extract_all(host, F.lit("([a-z0-9]+)"), F.lit(1)), lambda x: ~x.isin(*PLAIN_LABELS))
    runs = F.flatten(F.transform(labels, lambda x: F.regexp_extract_all(x, F.lit("([a-z]+|[0-9]+)"), F.lit(1))))
    more = F.regexp_extract_all(F.translate(path, UPPER, UPPER.lower()), F.lit("([a-z]+|[0-9]+)"), F.lit(1))
    named = lambda tag: lambda x: F.concat(F.lit(tag), F.when(x.rlike("^[0-9]"), "0").otherwise(x))
    return F.concat(F.transform(runs, named("h:")), F.transform(more, named("p:")))


def best_split(text: str, costs: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """Viterbi over ``text``: the cheapest split into words, known ones (from, to) at ``costs`` and any others at
    ``unknown`` and ``UNKNOWN_LETTER`` for each letter. Of equal splits the one with the longest last word."""
    ending: dict[int, list[tuple[int, float]]] = {}
    for (i, j), c in sorted(costs.items()):
        ending.setdefault(j, []).append((i, c))
    best, back = [0.0], [0]
    # The best start of an unknown word is the same for all of its ends.
    low, low_at = 0.0, 0
    for j in range(1, len(text) + 1):
        found, at = low + unknown + UNKNOWN_LETTER * j, low_at
        for i, c in ending.get(j, ()):
            if best[i] + c < found - 1e-12 or abs(best[i] + c - found) <= 1e-12 and i < at:
                found, at = best[i] + c, i
        best.append(found)
        back.append(at)
        if found - UNKNOWN_LETTER * j < low - 1e-12:
            low, low_at = found - UNKNOWN_LETTER * j, j
    out, j = [], len(text)
    while j:
        out.append(text[back[j] : j])
        j = back[j]
    return out[::-1]


def corpus_words(pages: DataFrame) -> DataFrame:
    """(word, n): counts of all a-z words of all pages' text, summed in each task first; seed words count
    ``SEED_WEIGHT`` times at least."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for html in batch.column("html").to_pylist():
                if html:
                    total.update(LETTERS.findall(TAG.sub(" ", html).lower()))
            if len(total) > 1_000_000:
                yield out()
                total.clear()
        yield out()

    counted = pages.select(F.col("html").cast("string").alias("html")).mapInArrow(count, "word string, n long").withColumn("least", F.lit(0))
    seeds = pages.sparkSession.createDataFrame([(w, 0, SEED_WEIGHT) for w in SEED_BLOCK], "word string, n long, least int")
    return counted.unionByName(seeds).groupBy("word").agg(F.greatest(F.sum("n"), F.max("least").cast("long")).alias("n"))


def segments(pieces: DataFrame, words: DataFrame) -> DataFrame:
    """(piece, tokens): each distinct run of letters of ``pieces`` (piece, with its tag) split by a unigram model
    over ``words`` (word, n).

    Only words that are part of some piece matter; each piece meets those that are part of it, and no task or
    driver holds the whole list. Frequent parts meet their pieces apart.
    """
    of = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("words"), F.collect_set(F.length("word")).alias("lengths")).first()
    total, lengths = of["n"] + of["words"] + 1, sorted(of["lengths"])
    unknown = math.log(total)
    runs = pieces.select(F.substring("piece", 3, 1 << 30).alias("run")).filter("run <> '0'").distinct()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.column("run").to_pylist():
                found = list({run[i : i + n] for n in lengths if n <= len(run) for i in range(len(run) - n + 1)})
                yield pa.RecordBatch.from_arrays([pa.array([run] * len(found), pa.string()), pa.array(found, pa.string())], names=["run", "word"])

    pairs = written(runs.mapInArrow(parts, "run string, word string"), "parts")
    known = written(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("runs")).join(words, "word"), "known")
    met = spread_join(pairs, known, ["word"], "runs").groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for run, found in zip(batch.column("run").to_pylist(), batch.column("known").to_pylist(), strict=True):
                costs = {}
                for x in found or ():
                    cost, at = -math.log((x["n"] + 1) / total), run.find(x["word"])
                    while at >= 0:
                        costs[at, at + len(x["word"])] = cost
                        at = run.find(x["word"], at + 1)
                out.append(best_split(run, costs, unknown))
            yield pa.RecordBatch.from_arrays([batch.column("run"), pa.array(out, pa.list_(pa.string()))], names=["run", "tokens"])

    return runs.join(met, "run", "left").mapInArrow(split, "run string, tokens array<string>")


def token_weights(counted: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, weight) of multinomial naive Bayes with additive smoothing and even priors, in millionths.

    ``counted`` has pieces with the numbers of urls' pieces that rules block and allow; ``tokens`` says what a piece
    is made of. Seed words count as tokens of blocked hosts.
    """
    of = counted.filter("block + allow > 0").join(tokens, "piece").select(F.explode("tokens").alias("token"), "block", "allow")
    seeds = counted.sparkSession.createDataFrame([(f"h:{w}", SEED_WEIGHT, 0) for w in SEED_BLOCK], "token string, block long, allow long")
    sums = written(of.unionByName(seeds).groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "tokens")
    all_ = sums.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count(F.lit(1)).alias("n")).first()
    log = lambda c: F.log((F.col(c) + 1) / F.lit(float(all_[c] + all_["n"] + 1)))
    return sums.select("token", F.round((log("block") - log("allow")) * SCALE).cast("long").alias("weight"))


def filter_urls(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict and the classifier's score.

    The longest rule that fits decides. All other urls, also empty ones and nulls, get the sign of the log odds
    that naive Bayes gives their segmented host and path tokens: ``block`` above 0, else ``allow``; tokens that no
    rule-labelled url has say nothing. Without any such url, seeds alone decide. Repeated rows give a row each, also
    those without page_id; very long urls are split whole; an empty table gives no rows; other columns are left
    alone. Counts, splits and weights are tables over all rows, however many words there are.
    """
    keyed, a, b = with_row_key(pages)
    host, path = host_and_path("url")
    urls = keyed.select(F.col(a).alias("row_a"), F.col(b).alias("row_b"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("row_a", "row_b", "page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule("host", "path")
    urls = urls.withColumn("rule", rule).withColumn("said", verdict)
    parts = urls.select("row_a", "row_b", "said", F.explode(url_pieces("host", "path")).alias("piece"))
    of_url = written(parts.groupBy("piece").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("said") == "block").alias("block"), F.count_if(F.col("said") == "allow").alias("allow")), "pieces")
    runs = written(segments(of_url, written(corpus_words(pages), "words")), "segments")
    tagged = of_url.select("piece", F.substring("piece", 3, 1 << 30).alias("run")).join(runs, "run", "left")
    tokens = written(tagged.select("piece", F.transform(F.coalesce("tokens", F.array("run")), lambda t: F.concat(F.substring("piece", 1, 2), t)).alias("tokens")), "piece_tokens")
    weights = token_weights(of_url, tokens)
    # Weights of pieces, one row each; what many urls hold meets them apart.
    summed = tokens.select("piece", F.explode("tokens").alias("token")).join(weights, "token").groupBy("piece").agg(F.sum("weight").alias("weight"))
    scored = written(summed.join(of_url.select("piece", "n"), "piece"), "scores")
    scores = spread_join(parts.select("row_a", "row_b", "piece"), scored, ["piece"], "n").groupBy("row_a", "row_b").agg(F.sum("weight").alias("weight"))
    score = F.coalesce(F.col("weight"), F.lit(0)) / F.lit(float(SCALE))
    out = urls.join(scores, ["row_a", "row_b"], "left").withColumn("score", score)
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score")
