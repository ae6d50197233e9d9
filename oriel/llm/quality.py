"""Quality rules on repetition, from a suffix array over the words of each text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from oriel.llm.common import text_bytes
from oriel.llm.suffix import SuffixArray

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

#: Bytes of text that one suffix array covers, and the last text that passes them.
BLOCK_BYTES = 1 << 20

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat")


def union_lengths(start: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """A mask of the positions that the spans ``[start, stop)`` cover."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, stop, -1)
    return np.cumsum(edge[:-1]) > 0


def lcp_intervals(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The longest-common-prefix intervals of at least ``least``, in one pass with a stack.

    ``lcp[j]`` is what rows j - 1 and j of a suffix array share. An interval is a maximal range of rows that share
    its value; such rows start the same substring, which no further symbol continues in all of them. Returns the
    places j with ``lcp[j] >= least``, the interval that has each place's own value, and the first row, last row
    and value of each interval.
    """
    places = np.flatnonzero(lcp >= least)
    own: list[int] = []
    first: list[int] = []
    last: list[int] = []
    value: list[int] = []
    stack: list[int] = []  # intervals that go on, from the widest to the deepest
    before = -2
    for j, v in zip(places.tolist(), lcp[places].tolist(), strict=True):
        if j != before + 1:
            for k in stack:
                last[k] = before
            stack.clear()
        left = j - 1
        while stack and value[stack[-1]] > v:
            k = stack.pop()
            last[k] = j - 1
            left = first[k]
        if not stack or value[stack[-1]] < v:
            stack.append(len(value))
            first.append(left)
            last.append(j)
            value.append(v)
        own.append(stack[-1])
        before = j
    for k in stack:
        last[k] = before
    return places, *(np.array(x, np.int64) for x in (own, first, last, value))


def repetition(texts: list[list[bytes]], least: int, window: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each list of words: words in repeated ``window``-word windows; words that maximal repeats of
    ``least`` words or more cover; words of the longest repeat.

    One suffix array covers all the texts; word numbers are shifted by text, so that nothing matches
    across texts. A repeat is maximal if it is the value of a longest-common-prefix interval (it can't grow to the
    right) and its occurrences don't all follow the same word (nor to the left). Spans are laid for each
    occurrence of a maximal repeat that is in no deeper interval; all other repeats lie inside of these.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    n_texts, total = len(texts), int(sizes.sum())
    if not total:
        z = np.zeros(n_texts, np.int64)
        return z, z.copy(), z.copy()
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for t in texts for w in t), np.int64, total)
    owner = np.repeat(np.arange(n_texts), sizes)
    # A separator that occurs once stands after each text.
    at = np.arange(total) + owner
    keys = np.empty(total + n_texts, np.int64)
    keys[at] = (owner << 32) | (ids + 1)
    ends = np.cumsum(sizes) + np.arange(n_texts)
    keys[ends] = np.arange(n_texts) << 32
    sa = SuffixArray(keys)
    n = len(keys)
    lcp = np.zeros(n + 1, np.int64)  # of each suffix in order with the one before it
    lcp[1:n] = sa.common(sa.order[:-1], sa.order[1:])
    longest = np.empty(n, np.int64)
    longest[sa.order] = np.maximum(lcp[:-1], lcp[1:])
    places, own, low, high, value = lcp_intervals(lcp, min(window, least))
    follows = keys[sa.order - 1]
    changes = np.append(0, np.cumsum(follows[1:] != follows[:-1]))
    maximal = changes[high] > changes[low]
    # A row's deepest interval is that of the larger of the two values beside it.
    deepest = np.full(n + 1, -1, np.int64)
    deepest[places] = own
    rows = np.unique(np.concatenate([places - 1, places]))
    mine = np.where(lcp[rows] >= lcp[rows + 1], deepest[rows], deepest[rows + 1])
    good = maximal[mine]
    start, length = sa.order[rows[good]], value[mine[good]]
    out = []
    for k in (window, least):
        some = length >= k
        out.append(union_lengths(start[some], (start + length)[some], n))
    first = np.append(0, ends[:-1] + 1)
    counted = [np.add.reduceat(m.astype(np.int64), first) for m in out]
    return counted[0], counted[1], np.maximum.reduceat(longest, first)


def measure(texts: list, least: int, block_bytes: int = BLOCK_BYTES) -> dict[str, np.ndarray]:
    """All counts of each text; words are made and compared for about ``block_bytes`` of text at a time."""
    found = {k: np.zeros(len(texts), np.int64) for k in COUNTS}
    i = 0
    while i < len(texts):
        words: list[list[bytes]] = []
        j, size = i, 0
        while j < len(texts) and (j == i or size < block_bytes):
            b = text_bytes(texts[j])
            w = b.split()
            solid = b.translate(None, SPACE)
            found["n_words"][j] = len(w)
            found["word_chars"][j] = len(solid.decode("utf-8", "surrogatepass"))
            found["n_symbols"][j] = len(b) - len(b.translate(None, SYMBOLS))
            lines = [x for x in b.split(b"\n") if x.strip(SPACE)]
            found["n_dup_lines"][j] = len(lines) - len(set(lines))
            words.append(w)
            size += len(b)
            j += 1
        found["n_repeat_words"][i:j], found["n_covered"][i:j], found["longest_repeat"][i:j] = repetition(words, least)
        i = j
    return found


def verdicts(f: dict[str, np.ndarray], least: int, max_covered: float, max_longest: int) -> tuple[np.ndarray, np.ndarray]:
    base = (f["n_words"] < 10) | (100 * f["n_repeat_words"] > 20 * f["n_words"])
    kept = ~base & (f["n_covered"] <= max_covered * f["n_words"]) & (f["longest_repeat"] <= max_longest)
    return base, kept


def quality_rules(docs: DataFrame, least: int = 8, max_covered: float = 0.15, max_longest: int = 60) -> DataFrame:
    """One row per document: counts, base rules, and the verdict of the suffix-array rules.

    A text fails if it has fewer than 10 words, if over 20 % of its words stand in five-word windows
    that occur twice, if maximal repeats of ``least`` words or more cover over ``max_covered`` of it,
    or if its longest repeat has over ``max_longest`` words. Null and empty texts have no words and so
    fail; repeated rows give a row each; a very long text has a suffix array of its own, over all of it; an empty
    table gives no rows; columns other than doc_id and text are left alone.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = measure(batch.column("text").to_pylist(), least)
            base, kept = verdicts(f, least, max_covered, max_longest)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(f[k]) for k in COUNTS), pa.array(base), pa.array(kept)], names=["doc_id", *COUNTS, "base_failed", "kept"])

    schema = f"doc_id long, {', '.join(f'{k} long' for k in COUNTS)}, base_failed boolean, kept boolean"
    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text").mapInArrow(judge, schema)


def keep_good(docs: DataFrame, least: int = 8, max_covered: float = 0.15, max_longest: int = 60) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; each goes by its own text, repeated rows too."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, kept = verdicts(measure(batch.column("text").to_pylist(), least), least, max_covered, max_longest)
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(judge, docs.schema)


def brute_force(text) -> tuple[int, int, int, int, int]:
    """(n_words, n_repeat_words, covered by repeats of 8 words, longest repeat, n_dup_lines), slowly."""
    words = text_bytes(text).split()
    n = len(words)
    masks = []
    for k in (5, 8):
        seen: dict[tuple, list[int]] = {}
        for i in range(n - k + 1):
            seen.setdefault(tuple(words[i : i + k]), []).append(i)
        masks.append({p + d for at in seen.values() if len(at) > 1 for p in at for d in range(k)})
    longest = 0
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest = max(longest, k)
    earlier, dup = set(), 0
    for line in text_bytes(text).split(b"\n"):
        if line.split():
            dup += line in earlier
            earlier.add(line)
    return n, len(masks[0]), len(masks[1]), longest, dup
