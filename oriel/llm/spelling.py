"""Spelling variants: words one edit apart, found by automata over the halves of words, and the forms they go back to."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel.llm.common import written

#: Code points of a word at least, occurrences at least, and how many times as frequent a form must be.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: Fixed values of the made variants: of runs whose checksum it divides, one code point is deleted.
DIVISOR = 199
#: Words whose segments one automaton holds, about.
SHARD = 32_768
#: Words that a task counts before it hands them on, and characters of a text that are read at a time.
HELD, SLICE = 300_000, 1 << 20

LOWER = {i: i + 32 for i in range(65, 91)}


def runs(text: str, least: int) -> Counter:
    """Maximal runs of letters of at least ``least`` code points, as they stand. A long text is read in slices that end
    outside of runs."""
    pattern = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")
    if len(text) <= SLICE:
        return Counter(pattern.findall(text))
    out: Counter = Counter()
    gap, start = re.compile("[^A-Za-zÀ-ÿ]"), 0
    while start < len(text):
        end = gap.search(text, min(start + SLICE, len(text)))
        stop = end.start() if end else len(text)
        out.update(pattern.findall(text[start:stop]))
        start = stop + 1
    return out


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and how often a task has seen them, with the made variants."""
    held: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            if not text.is_valid:
                continue
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for word, n in runs(text.as_py(), LEAST_LENGTH).items():
                word = word.lower() if word.isascii() else word.translate(LOWER)
                h = zlib.crc32(word.encode(), start)
                if not h % DIVISOR:
                    i = h % len(word)
                    word = word[:i] + word[i + 1 :]
                    if len(word) < LEAST_LENGTH:
                        continue
                held[word] = held.get(word, 0) + n
            if len(held) >= HELD:
                yield out()
                held.clear()
    yield out()


def half(word: str) -> int:
    """The first segment is so long; both have at least three code points."""
    return len(word) // 2


class Halves:
    """An automaton over the two segments of words.

    A word one edit away from a held word has one of the held word's segments unchanged: the first at its start, or the
    second at its end. What remains of the two words then differs by that one edit. Under each segment the remainders are
    listed in full and with each code point left out, so that a word meets only those it is near to, however many words
    share the segment.
    """

    def __init__(self, words: list[tuple[str, str, int]]):
        """``words``: (side, word, n); side ``L`` holds first segments, ``R`` second ones."""
        self.automaton = ahocorasick.Automaton()
        self.full: dict[tuple, tuple[str, int]] = {}
        self.cut: dict[tuple, list[tuple[str, int]]] = {}
        self.lengths: dict[int, set[int]] = {}
        number: dict[tuple[str, str], int] = {}
        segments: dict[str, list[tuple[int, str]]] = {}
        for side, word, n in words:
            k = half(word)
            segment, rest = (word[:k], word[k:]) if side == "L" else (word[k:], word[:k])
            at = number.setdefault((side, segment), len(number))
            if at not in self.lengths:
                self.lengths[at] = set()
                segments.setdefault(segment, []).append((at, side))
            self.lengths[at].add(len(rest))
            self.full[at, rest] = word, n
            for i in range(len(rest)):
                self.cut.setdefault((at, i, rest[:i] + rest[i + 1 :]), []).append((word, n))
        for segment, owners in segments.items():
            self.automaton.add_word(segment, (len(segment), owners))
        self.automaton.make_automaton()

    def near(self, word: str, side: str) -> dict[str, int]:
        """Held words, with their n, of which ``side``'s segment stands in ``word`` at its place and one edit apart.

        A word whose first segment stands in ``word`` too is left to side ``L``, so each is found on one side only.
        """
        out: dict[str, int] = {}
        last = len(word) - 1
        for end, (length, owners) in self.automaton.iter(word):
            if side == "L" and end != length - 1 or side == "R" and end != last:
                continue
            for at, owner in owners:
                if owner != side:
                    continue
                rest = word[length:] if side == "L" else word[: last + 1 - length]
                m = len(rest)
                known = self.lengths[at]
                if m + 1 in known:  # the held word has one more code point
                    for i in range(m + 1):
                        for w, n in self.cut.get((at, i, rest), ()):
                            out[w] = n
                if m - 1 in known or m in known:
                    for i in range(m):
                        short = rest[:i] + rest[i + 1 :]
                        if x := self.full.get((at, short)):
                            out[x[0]] = x[1]
                        for w, n in self.cut.get((at, i, short), ()):
                            if w != word and len(w) == last + 1:
                                out[w] = n
        if side == "R":
            out = {w: n for w, n in out.items() if not word.startswith(w[: half(w)])}
        return out


PARTIAL = "word string, n_near long, form_n long, form string"


def scan(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: rows (side, word, n, held, scanned); for each scanned word how many held ones are near, and the most frequent."""
    held = rows[rows["held"]]
    shard = Halves(list(zip(held["side"], held["word"], held["n"].tolist(), strict=True)))
    out = []
    read = rows[rows["scanned"]]
    if len(held):
        for side, word in zip(read["side"], read["word"], strict=True):
            if near := shard.near(word, side):
                n = max(near.values())
                out.append((word, len(near), n, min(w for w, m in near.items() if m == n)))
    return pd.DataFrame(out, columns=["word", "n_near", "form_n", "form"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least six code points that occur five times or more over all texts, each text whole."""
    seen = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(counted, "word string, n long")
    return seen.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(word, n_near, form_n, form) for words (word, n) that have near ones: how many, and the most frequent of them.

    A shard takes the words that share hashes of their first three (side ``L``) or last three code points (side ``R``):
    each segment starts or ends with them, so a word meets all segments that can stand at its start or end. Where one
    beginning or end is so frequent that a shard would hold over twice ``shard`` words, they are dealt into parts, and each
    part is scanned with each; no task holds more than two parts.
    """
    total = words.count()
    bins = max(1, -(-2 * total // shard))
    ends = F.array(F.struct(F.lit("L").alias("side"), F.substring("word", 1, 3).alias("anchor")), F.struct(F.lit("R").alias("side"), F.substring("word", -3, 3).alias("anchor")))
    sided = words.select("word", "n", F.inline(ends)).withColumn("bin", F.pmod(F.xxhash64("side", "anchor"), F.lit(bins))).drop("anchor")
    sizes = sided.groupBy("bin").agg(F.count(F.lit(1)).alias("_n"))
    parts = F.when(F.col("_n") > 2 * shard, F.ceil(F.col("_n") / shard)).otherwise(1).cast("int")
    large = F.broadcast(sizes.withColumn("parts", parts).filter("parts > 1").select("bin", "parts"))
    dealt = sided.join(large, "bin", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    each = F.sequence(F.lit(0), F.col("parts") - 1)
    one = F.struct(F.lit(0).alias("held_part"), F.lit(0).alias("scanned_part"), F.lit(True).alias("held"), F.lit(True).alias("scanned"))
    both = F.concat(
        F.transform(each, lambda p: F.struct(F.col("own").alias("held_part"), p.alias("scanned_part"), F.lit(True).alias("held"), (p == F.col("own")).alias("scanned"))),
        F.transform(F.filter(each, lambda p: p != F.col("own")), lambda p: F.struct(p.alias("held_part"), F.col("own").alias("scanned_part"), F.lit(False).alias("held"), F.lit(True).alias("scanned"))),
    )
    met = dealt.select("bin", "side", "word", "n", F.inline(F.when(F.col("parts") == 1, F.array(one)).otherwise(both)))
    partial = met.groupBy("bin", "held_part", "scanned_part").applyInPandas(scan, PARTIAL)
    most = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), most.alias("best")).select("word", "n_near", (-F.col("best.m")).alias("form_n"), F.col("best.form").alias("form"))


def roots(forms: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(word, root) for (word, form): forms are followed to the last; each round doubles the steps that are known.

    A form is several times as frequent as its word, so chains end after as many steps as the logarithm of the highest
    count; should ``max_rounds`` not end them, an error is raised.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(max_rounds):
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return now
    raise RuntimeError(f"forms don't end after {max_rounds} rounds")


def spelling_groups(docs: DataFrame, shard: int = SHARD) -> DataFrame:
    """Words of all texts with the form and root of each: word, form, root, n, n_near, form_n.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased, some of them with a made error.
    ``form`` is the most frequent word one edit away (ties: the smallest), if it is at least five times as
    frequent; ``root`` follows forms to the last.

    A null or empty text has no words; a null doc_id reads as an empty one where errors are made. Rows are texts of their
    own, also if they repeat or share an id. An empty table gives no row. Other columns aren't read.
    """
    words = written(word_counts(docs), "words")
    found = written(near_words(words, shard), "near_words")
    forms = words.join(found, "word").filter(F.col("form_n") >= TIMES * F.col("n")).select("word", "form", "form_n")
    ends = roots(forms)
    out = words.join(found.select("word", "n_near"), "word", "left").join(forms, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("form_n").cast("long").alias("form_n"))


def brute_force(docs: list[tuple[int | None, str | None]]) -> list[tuple]:
    """The same by comparing all words with each other, for tests."""
    counts: Counter = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % DIVISOR == 0:
                run = "".join(c for i, c in enumerate(run) if i != h % len(run))
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def close(a: str, b: str) -> bool:
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    near = {w: [v for v in words if close(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        top = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = top if top is not None and words[top] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out
