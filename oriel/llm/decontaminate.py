"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's word windows."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel.llm.common import shared_path, text_bytes, with_row_key

#: Words are runs of digits, letters a-z and everything beyond ASCII, after lower-casing A-Z.
#: In UTF-8 each byte of a character beyond ASCII is 0x80 or more, so words can be found on bytes.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

#: Words of the benchmark in one automaton, about at most: it has up to 26 nodes for each, of some 80 bytes. A larger
#: benchmark is dealt into blocks, each scanned in turn.
BLOCK_WORDS = 200_000
#: Words of one item that stay together; longer items are dealt in pieces that overlap, so that no window is lost.
PIECE_WORDS = 20_000

SCAN_SCHEMA = "row_a long, row_b long, doc_id long, n_words long, hits array<struct<first:int,last:int>>, spans array<struct<start:int,stop:int>>, items array<string>"


def folded_words(text) -> list[bytes]:
    return text_bytes(text).translate(FOLD).split()


#: Second letters of a word's pair; first letters start behind them.
PAIR = 512
#: Stands for words that no item has.
UNKNOWN = "\0\0"


def letters(k: int) -> str:
    """The pair of letters that stands for the ``k``-th word. Two letters keep nodes narrow, as the automaton looks
    through a node's branches one by one; first and second letters differ, so that no window matches out of step."""
    return chr(2 * PAIR + k // PAIR) + chr(1 + k % PAIR)


class WindowMachine:
    """One Aho-Corasick automaton over word windows; its letters are word numbers, so a window has two nodes for each word."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        import ahocorasick

        self.letters: dict[bytes, str] = {}
        owners: dict[str, set[str]] = {}
        for item, text in items:
            line = [self.letters.setdefault(w, letters(len(self.letters))) for w in folded_words(text)]
            for i in range(max(1, len(line) - size + 1) if line else 0):
                owners.setdefault("".join(line[i : i + size]), set()).add(item)
        self.machine = ahocorasick.Automaton()
        for window, own in owners.items():
            self.machine.add_word(window, (len(window) // 2, tuple(own)))
        if owners:
            self.machine.make_automaton()
        self.empty = not owners

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[str, ...]]]:
        """(first word, last word, items) of each window that ``words`` hold."""
        if self.empty or not words:
            return
        get = self.letters.get
        for end, (size, own) in self.machine.iter("".join([get(w, UNKNOWN) for w in words])):
            last = end // 2
            yield last - size + 1, last, own


#: The automaton that a worker built last, by the folder and block that it is made of.
_BUILT: dict[tuple[str, int, int], WindowMachine] = {}


def built(folder: str, block: int, size: int) -> WindowMachine:
    """The automaton of one written block; a worker builds it once and keeps one."""
    if (folder, block, size) not in _BUILT:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        files = [f.path for f in system.get_file_info(fs.FileSelector(f"{root}/block={block}", allow_not_found=True)) if f.path.endswith(".parquet")]
        items: list[tuple[str, str]] = []
        for name in sorted(files):
            with system.open_input_file(name) as source:
                rows = pq.read_table(source, columns=["item_id", "text"], partitioning=None)
            items += zip(rows["item_id"].to_pylist(), rows["text"].to_pylist(), strict=True)
        _BUILT.clear()
        _BUILT[folder, block, size] = WindowMachine(items, size)
    return _BUILT[folder, block, size]


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return [tuple(x) for x in out]


def scanned(machine: WindowMachine, text) -> tuple[int, list[tuple[int, int]], list[str | None]]:
    """Words of a text, the runs of words that windows hit, and the items found."""
    words = folded_words(text)
    hits, found = [], set()
    for first, last, own in machine.find(words):
        hits.append((first, last))
        found.update(own)
    return len(words), merged(hits), sorted(found, key=lambda x: (x is None, x or ""))


FOUND = pa.schema(
    [
        ("n_words", pa.int64()),
        ("hits", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def scan(batches: Iterator[pa.RecordBatch], machine: WindowMachine, every: bool = True) -> Iterator[pa.RecordBatch]:
    """Run the automaton once over each text; map hit words back to offsets in the original. ``every`` row is
    returned, or only those with hits."""
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            n_words, hits, items = scanned(machine, text)
            spans = []
            if hits:
                at = [m.span() for m in WORD.finditer(text)]
                spans = [{"start": at[x][0], "stop": at[y][1]} for x, y in hits]
            rows.append({"n_words": n_words, "hits": [{"first": x, "last": y} for x, y in hits], "spans": spans, "items": items})
        found = pa.RecordBatch.from_pylist(rows, schema=FOUND)
        out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row_a", "row_b", "doc_id")), *found.columns], names=["row_a", "row_b", "doc_id", *FOUND.names])
        yield out if every else out.filter(pa.array([bool(r["hits"]) for r in rows], pa.bool_()))


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits and spans of several blocks as one automaton would give them: runs of words that touch are one, from the
    start of its first word to the end of its last."""
    for batch in batches:
        hits, spans = [], []
        for h, s in zip(batch.column("hits").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            starts = {x["first"]: y["start"] for x, y in zip(h, s, strict=True)}
            stops = {x["last"]: y["stop"] for x, y in zip(h, s, strict=True)}
            runs = merged([(x["first"], x["last"]) for x in h])
            hits.append([{"first": x, "last": y} for x, y in runs])
            spans.append([{"start": starts[x], "stop": stops[y]} for x, y in runs])
        columns = {c: batch.column(c) for c in batch.schema.names} | {"hits": pa.array(hits, FOUND.field("hits").type), "spans": pa.array(spans, FOUND.field("spans").type)}
        yield pa.RecordBatch.from_pydict(columns)


def benchmark_blocks(benchmark: DataFrame, window: int, block_words: int) -> tuple[str, int]:
    """The benchmark's items written by blocks to the shared folder: the folder and the number of blocks."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    words = F.regexp_extract_all(F.translate("text", UPPER, UPPER.lower()), F.lit(f"({WORD.pattern})"), F.lit(1))
    cut = items.withColumn("words", words).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(PIECE_WORDS))
    pieces = cut.withColumn("at", F.explode(starts)).select("item_id", "at", F.array_join(F.slice("words", F.col("at") + 1, PIECE_WORDS + window - 1), " ").alias("text"), F.least(F.size("words") - F.col("at"), F.lit(PIECE_WORDS + window - 1)).alias("n"))
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(1.25 * total / block_words)) if total > block_words else 1
    folder = shared_path(benchmark.sparkSession, "benchmark")
    pieces.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text", "at"), F.lit(blocks)).cast("int").alias("block")).repartition("block").write.partitionBy("block").parquet(folder)
    return folder, blocks


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: its words, hit words, hit spans in the original and matching items.

    ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` ``item_id`` and ``text``; other columns are
    left alone. Null and empty texts have no words; an item without words matches nothing, an item
    shorter than the window is one window. Items without an id hit words like others; they count as
    one item together, a null in ``items`` that the digest leaves out. Repeated rows give a row each; an empty benchmark gives
    rows without hits, an empty table no rows. Very long texts are scanned whole, one at a time. Spans are code
    point offsets ``[start, stop)`` of the original text.

    The benchmark is the stated query set. It is written to the shared folder in blocks of about ``block_words``
    words, mostly one; each scanning task reads a block and builds its automaton. Hits of several
    blocks are united by row.
    """
    folder, blocks = benchmark_blocks(benchmark, window, block_words)
    keyed, a, b = with_row_key(docs)
    return judged(keyed, a, b, folder, blocks, window).drop("row_a", "row_b")


def judged(keyed: DataFrame, a: str, b: str, folder: str, blocks: int, window: int) -> DataFrame:
    """``decontaminate`` for rows that ``a`` and ``b`` tell apart, with those as row_a and row_b."""
    texts = keyed.select(F.col(a).alias("row_a"), F.col(b).alias("row_b"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [texts.mapInArrow(lambda it, k=k: scan(it, built(folder, k, window), every=k == 0), SCAN_SCHEMA) for k in range(blocks)]
    found = parts[0]
    if blocks > 1:
        for p in parts[1:]:
            found = found.unionByName(p)
        together = lambda c: F.flatten(F.collect_list(c)).alias(c)
        found = found.groupBy("row_a", "row_b").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), together("hits"), together("spans"), F.array_distinct(together("items")).alias("items"))
        found = found.mapInArrow(united, SCAN_SCHEMA)
    # Ranges are apart and in order; their lengths are summed.
    hit = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["last"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(acc["end"], x["first"] - 1))).cast("long").alias("n"),
        ),
        lambda acc: acc["n"],
    )
    return found.select(
        "row_a",
        "row_b",
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        F.array_sort("items").alias("items"),
        F.array_sort("spans").alias("spans"),
    ).withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns.

    Each row is judged by its own text, whatever its doc_id, and rows without words stay. Where one
    automaton holds the benchmark, the scan itself filters; with several, rows go by their joint verdict.
    """
    folder, blocks = benchmark_blocks(benchmark, window, block_words)
    if blocks > 1:
        keyed, a, b = with_row_key(docs)
        bad = judged(keyed, a, b, folder, blocks, window).filter("contaminated").select(F.col("row_a").alias(a), F.col("row_b").alias(b))
        return keyed.join(bad, [a, b], "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = built(folder, 0, window)
        for batch in batches:
            keep = []
            for text in batch.column("text").to_pylist():
                n_words, hits, _ = scanned(machine, text)
                n_hit = sum(last - first + 1 for first, last in hits)
                keep.append(not (n_hit > 0 and 20 * n_hit >= n_words))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def brute_force(docs: list[tuple], items: list[tuple], size: int = 13) -> list[tuple]:
    """The contract, word by word, for small inputs: (doc_id, n_words, n_hit, n_items, sha, contaminated)."""
    cut = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: cut.findall((t or "").translate(lower))
    out = []
    for doc_id, text in docs:
        w, hit, own = words(text), set(), set()
        for item, body in items:
            b = words(body)
            for i in range(max(1, len(b) - size + 1) if b else 0):
                x = b[i : i + size]
                for j in range(len(w) - len(x) + 1):
                    if w[j : j + len(x)] == x:
                        hit |= set(range(j, j + len(x)))
                        own.add(None if item is None else str(item))
        sha = hashlib.sha256(",".join(sorted(own - {None})).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(own), sha, bool(hit) and 20 * len(hit) >= len(w)))
    return out
