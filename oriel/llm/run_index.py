"""Exact removal of repeated 200-byte strings, by run-length indexes over anchored contexts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel.llm.common import drop_table, mix64, spread_join, text_bytes, written
from oriel.llm.suffix import SuffixArray

LENGTH = 200
#: Bytes of the anchors by which equal strings meet.
ANCHOR = 32
#: Windows looked at in one go; longer texts are taken in overlapping pieces.
PIECE = 1 << 20
#: Bytes of contexts that one index covers, if whole groups of an anchor allow it.
INDEX_BYTES = 2 << 20
#: Distinct contexts of an anchor that one index holds; those of an anchor with more are cut anew by longer anchors.
WIDE = 1024

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=_U))


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, _U)
    x[:1] = 1
    return np.multiply.accumulate(x)


class Piece:
    """Hashes of any slice of ``data``, from running sums of its bytes times powers."""

    _up = _down = np.empty(0, _U)

    def __init__(self, data: np.ndarray):
        n = len(data)
        if len(Piece._up) < n + 1:
            Piece._up, Piece._down = _powers(_BASE, 2 * n + 2), _powers(_INVERSE, 2 * n + 2)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(_BYTE[data] * Piece._up[:n], out=self.sums[1:])

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix64((self.sums[stop] - self.sums[start]) * Piece._down[start] + (stop - start).astype(_U))


def owners(hashes: np.ndarray, span: int) -> np.ndarray:
    """For each run of ``span`` hashes the place of its lowest one, the first of equals."""
    bits = max(1, int(len(hashes)).bit_length())
    low = (hashes >> _U(bits) << _U(bits)) | np.arange(len(hashes), dtype=_U)
    n, size = len(low) - span + 1, 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[span - size : span - size + n])
    return (low & _U((1 << bits) - 1)).astype(np.int64)


def contexts(data: np.ndarray, text_of_start: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Cut the windows of ``length`` bytes of ``data`` into runs with one anchor each.

    A window's anchor is its ``anchor``-byte string of the lowest hash, so equal windows have equal anchors at
    equal places. ``text_of_start`` tells, for every byte, where the piece's text ends. Returns for each run
    the first window, the last window, the place of the anchor, the anchor's hash and the hash of all its bytes.
    """
    n = len(data)
    if n < length:
        z = np.empty(0, np.int64)
        return z, z, z, z, z
    piece = Piece(data)
    at = np.arange(n - anchor + 1)
    own = owners(piece.hashes(at, at + anchor), length - anchor + 1)
    start = np.arange(len(own))
    valid = text_of_start[: len(own)] - start >= length
    change = np.ones(len(own), bool)
    change[1:] = (own[1:] != own[:-1]) | (valid[1:] != valid[:-1]) | (text_of_start[1 : len(own)] != text_of_start[: len(own) - 1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(own)) - 1
    good = valid[first]
    first, last = first[good], last[good]
    p = own[first]
    return first, last, p, piece.hashes(p, p + anchor).view(np.int64), piece.hashes(first, last + length).view(np.int64)


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Whole texts joined up to ``PIECE`` bytes, long ones alone in overlapping parts: bytes, ends of
    their texts for each byte, texts and their offsets (of first bytes in the piece and in the text)."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def joined():
        data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        sizes = np.array([len(x) for _, _, x in held])
        ends = np.cumsum(sizes)
        return data, np.repeat(ends, sizes), np.repeat([i for i, _, _ in held], sizes), np.repeat(ends - sizes - np.array([o for _, o, _ in held]), sizes)

    for i, b in enumerate(texts):
        if len(b) < length:
            continue
        for o in range(0, len(b) - length + 1, PIECE):
            part = b[o : o + PIECE + length - 1]
            if size + len(part) > PIECE + length and held:
                yield joined()
                held, size = [], 0
            held.append((i, o, part))
            size += len(part)
    if held:
        yield joined()


ANCHORS = "doc_id long, row long, start long, shape int, anchor long, context long"


def anchored(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, row, start, shape, anchor, context) for all contexts; shape is 65536 times the place of
    the anchor in it, plus its bytes beyond ``length``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, row = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("row").to_numpy(zero_copy_only=False)
            null = batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            for data, ends, text, offset in pieces([text_bytes(t) for t in batch.column("text").to_pylist()], length):
                first, last, p, h, c = contexts(data, ends, length, anchor)
                who = text[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.where(null[who], 0, doc[who]).astype(np.int64), mask=null[who]),
                        pa.array(row[who].astype(np.int64)),
                        pa.array(first - offset[first]),
                        pa.array(((p - first) << 16 | (last - first)).astype(np.int32)),
                        pa.array(h),
                        pa.array(c),
                    ],
                    names=["doc_id", "row", "start", "shape", "anchor", "context"],
                )

    return docs.mapInArrow(cut, ANCHORS)


class RunIndex:
    """Run-length compressed Burrows-Wheeler transform of ``texts``, with samples at the ends of runs.

    ``heads`` and ``starts`` are the runs: the symbol that precedes all rows of a run, and its first row; they
    alone give the texts back (``texts``). At the head (end) of each run the longest common prefix with the row above
    (below) is sampled. A step through the transform from a row inside of a run lengthens that prefix by
    one symbol, so all others follow from the samples: ``statistics`` streams the texts past them.
    The suffix array isn't kept.
    """

    #: Symbols in a key, of 9 bits each: bytes count from 1, 0 ends a text.
    UNIT = 7

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        self.first = np.cumsum(sizes) - sizes
        joined = np.frombuffer(b"".join([t + b"\0" for t in texts]) + bytes(self.UNIT), np.uint8)
        n = len(joined) - self.UNIT
        left = np.repeat(self.first + sizes, sizes) - np.arange(n) - 1  # symbols before the text's end
        data = joined.astype(np.int64) + 1
        data[np.append(left == 0, np.ones(self.UNIT, bool))] = 0
        keys = np.zeros(n, np.int64)
        for k in range(self.UNIT):
            keys = keys << 9 | data[k : k + n]
        reaches = left < self.UNIT
        # What lies beyond an end takes no part in the order.
        keys[reaches] &= -1 << (9 * (self.UNIT - left[reaches]))
        sa = SuffixArray(keys, self.UNIT, reaches)
        order = sa.order
        before = data[order - 1]
        begins = np.zeros(n, bool)
        begins[self.first] = True
        before[begins[order]] = -1  # the start of a text follows nothing
        same = (before[1:] == before[:-1]) & (before[1:] >= 0)
        head, tail = np.append(True, ~same), np.append(~same, True)
        self.n, self.starts = n, np.flatnonzero(head)
        self.heads = before[self.starts].astype(np.int16)
        head[0] = tail[-1] = False
        up, down = np.flatnonzero(head), np.flatnonzero(tail)
        self.above = (order[up], self.prefix(sa, data, left, order[up - 1], order[up]))
        self.below = (order[down], self.prefix(sa, data, left, order[down], order[down + 1]))
        self.ends = (order[0], order[-1])

    def prefix(self, sa: SuffixArray, data: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        length = sa.common(a, b)
        going = np.ones(len(a), bool)
        for _ in range(self.UNIT - 1):
            x, y = np.minimum(a + length, self.n - 1), np.minimum(b + length, self.n - 1)
            going &= (length < left[a]) & (length < left[b]) & (data[x] == data[y])
            length += going
        return length

    def statistics(self) -> np.ndarray:
        """For each place of each text, how far it matches some other place of any text."""
        at = np.arange(self.n)
        out = np.zeros(self.n, np.int64)
        for (place, value), none in ((self.above, self.ends[0]), (self.below, self.ends[1])):
            sample = np.full(self.n, -1, np.int64)
            sample[place] = value
            sample[none] = 0
            known = np.maximum.accumulate(np.where(sample >= 0, at, 0))
            out = np.maximum(out, sample[known] - (at - known))
        return out

    def texts(self) -> list[bytes]:
        """The texts again, from the runs alone, by stepping back from the end of each."""
        sizes = np.diff(np.append(self.starts, self.n))
        symbols = np.unique(self.heads[self.heads >= 0])
        # The first row of each symbol's suffixes, after those of all smaller symbols (0 for the ends of texts).
        total = {int(c): int(sizes[self.heads == c].sum()) for c in symbols}
        first, at = {}, len(self.first)
        for c in sorted(total):
            first[c] = at
            at += total[c]
        before = np.zeros(len(sizes), np.int64)  # rows of the run's symbol in earlier runs
        for c in symbols:
            mine = np.flatnonzero(self.heads == c)
            before[mine] = np.cumsum(sizes[mine]) - sizes[mine]
        out = []
        for row in range(len(self.first)):
            text = bytearray()
            while True:
                run = int(np.searchsorted(self.starts, row, side="right")) - 1
                c = int(self.heads[run])
                if c < 0:
                    break
                text.append(c - 1)
                row = first[c] + int(before[run]) + row - int(self.starts[run])
            out.append(bytes(text[::-1]))
        return out


def repeated_ranges(texts: list[bytes], weights: list[int], length: int = LENGTH) -> list[list[int]]:
    """For each text, the windows of ``length`` bytes that occur anywhere else, as first and last ones in turn.

    A text of weight 2 or more stands for as many equal ones, so all of it matches elsewhere.
    """
    index = RunIndex(texts)
    long = index.statistics() >= length
    out = []
    for f, t, w in zip(index.first.tolist(), texts, weights, strict=True):
        n = len(t) - length + 1
        if w > 1:
            out.append([0, n - 1])
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], long[f : f + n].view(np.int8), [0]])))
        edge[1::2] -= 1
        out.append(edge.tolist())
    return out


def indexed(rows: DataFrame, length: int = LENGTH, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(anchor, context, ranges) from (anchor, context, weight, bytes): repeated windows of each context.

    Contexts of an anchor meet in one task; several anchors share an index of about ``index_bytes``.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(held: pa.Table) -> pa.RecordBatch:
            held = held.combine_chunks()
            ranges = repeated_ranges(held["bytes"].to_pylist(), held["weight"].to_pylist(), length)
            keep = pa.array([bool(r) for r in ranges], pa.bool_())
            held = held.filter(keep).combine_chunks()
            flat = pa.array([r for r in ranges if r], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([*(held[c].combine_chunks() if held.num_rows else pa.array([], pa.int64()) for c in ("anchor", "context")), flat], names=["anchor", "context", "ranges"])

        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = pa.Table.from_batches([batch.slice(k, 1024)])
                held.append(part)
                size += int(pc.sum(pc.binary_length(part["bytes"])).as_py() or 0)
                if size < index_bytes:
                    continue
                rows_ = pa.concat_tables(held)
                keys = rows_["anchor"].to_numpy()
                whole = int(np.argmax(keys == keys[-1]))  # the last anchor may go on
                if whole:
                    yield found(rows_.slice(0, whole))
                    held = [rows_.slice(whole)]
                    size = int(pc.sum(pc.binary_length(held[0]["bytes"])).as_py() or 0)
        if held:
            yield found(pa.concat_tables(held))

    dealt = rows.repartition("anchor").sortWithinPartitions("anchor").select("anchor", "context", "weight", "bytes")
    return dealt.mapInArrow(search, "anchor long, context long, ranges array<int>")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))


CUTS = "anchor long, context long, weight long, wide boolean, bytes binary"
RECUT = "above_anchor long, above_context long, first int, anchor long, context long, weight long, bytes binary"


def recut(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """Contexts (anchor, context, weight, bytes) cut anew by anchors of ``anchor`` bytes: what they were cut from, the
    first window there, and their own anchor, context, weight and bytes. Where anchors are whole windows,
    bytes are null, as all contexts of an anchor are equal."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("bytes").to_pylist()
            old = [batch.column(c).to_numpy() for c in ("anchor", "context", "weight")]
            i = 0
            while i < len(data):
                j, size = i, 0
                while j < len(data) and (j == i or size < PIECE):
                    size += len(data[j])
                    j += 1
                sizes = np.array([len(x) for x in data[i:j]])
                ends = np.cumsum(sizes)
                flat = b"".join(data[i:j])
                first, last, _, h, c = contexts(np.frombuffer(flat, np.uint8), np.repeat(ends, sizes), length, anchor)
                who = np.searchsorted(ends, first, side="right")
                # Equal windows have equal anchors of either length, so both make the key.
                key = mix64(h.view(_U) + old[0][i:j][who].view(_U) * _U(0x9FB21C651E98DF25)).view(np.int64)
                whole = [flat[f : e + length] for f, e in zip(first.tolist(), last.tolist(), strict=True)] if anchor < length else [None] * len(first)
                columns = [old[0][i:j][who], old[1][i:j][who], (first - (ends - sizes)[who]).astype(np.int32), key, c, old[2][i:j][who]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(whole, pa.binary())], names=["above_anchor", "above_context", "first", "anchor", "context", "weight", "bytes"])
                i = j

    return rows.select("anchor", "context", "weight", "bytes").mapInArrow(cut, RECUT)


def ranges_of(rows: DataFrame, length: int, anchors: list[int], wide: int) -> DataFrame:
    """(anchor, context, ranges) from CUTS: by an index for each anchor, and for wide ones from shorter contexts,
    which are cut by the next of ``anchors``; the last of them is as long as a window, and leaves none wide."""
    out = indexed(rows.filter("NOT wide"), length)
    if not anchors:
        return out
    below = written(recut(rows.filter("wide"), length, anchors[0]), "recut")
    if below.isEmpty():
        return out
    folded = written(below.groupBy("anchor", "context").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"), F.any_value("bytes").alias("bytes")), "folded")
    widths = folded.groupBy("anchor").agg(F.count(F.lit(1)).alias("width"))
    known = folded.join(widths, "anchor")
    alone = known.filter("width = 1 AND weight > 1").select("anchor", "context", "n", F.when(F.lit(len(anchors) == 1), F.lit(0)).otherwise(F.octet_length("bytes") - length).alias("last"))
    found = alone.select("anchor", "context", "n", F.array(F.lit(0), F.col("last")).alias("ranges"))
    if len(anchors) > 1:
        more = known.filter("width > 1").select("anchor", "context", "weight", (F.col("width") > wide).alias("wide"), "bytes")
        n = folded.select("anchor", "context", "n")
        found = found.unionByName(ranges_of(written(more, "cuts"), length, anchors[1:], wide).join(n, ["anchor", "context"]))
    # Ranges go back to the contexts that were cut; frequent short contexts meet theirs apart.
    places = spread_join(below.drop("weight", "bytes"), written(found, "found"), ["anchor", "context"], "n")
    back = places.select(F.col("above_anchor").alias("anchor"), F.col("above_context").alias("context"), F.transform("ranges", lambda x: x + F.col("first")).alias("ranges"))
    return out.unionByName(back.groupBy("anchor", "context").agg(F.flatten(F.collect_list("ranges")).alias("ranges")))


def repeated_contexts(docs: DataFrame, length: int, anchor: int, wide: int) -> tuple[DataFrame, DataFrame]:
    """Places of all contexts whose anchor occurs more than once, and the repeated windows of each context.

    ``alike`` marks places whose anchor has one context only: all of its windows repeat, and no index is asked.
    """
    texts = keyed(docs)
    everything = written(anchored(texts, length, anchor), "anchors")
    counts = everything.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).filter("n > 1")
    counts = written(counts.select("anchor", "n", (F.col("low") == F.col("high")).alias("alike")), "counts")
    shared = written(spread_join(everything, counts, ["anchor"], "n"), "shared")
    drop_table(everything)
    distinct = shared.filter("NOT alike").groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("weight"), F.min(F.struct("doc_id", "row", "start", "shape")).alias("at"))
    distinct = written(distinct, "contexts")
    widths = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("width")).filter(F.col("width") > wide).select("anchor", F.lit(True).alias("is_wide"))
    n_wide = widths.count()
    chosen = distinct.join(F.broadcast(widths) if n_wide <= 10_000 else widths, "anchor", "left")
    wanted = chosen.groupBy(F.col("at.doc_id").alias("_d"), F.col("at.row").alias("_r")).agg(F.collect_list(F.struct("at.start", "at.shape", "anchor", "context", "weight", F.coalesce("is_wide", F.lit(False)).alias("wide"))).alias("cut"))
    # Rows that share doc_id and text are one here; their contexts carry the weight of both.
    source = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r"))).select("text", "cut")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("weight", pa.int64()), ("wide", pa.bool_()), ("bytes", pa.binary())])

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(col, f.type) for col, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        # Rows of equal doc_id and text cut the same contexts, whose weight is 2 or more: once is enough, as far as
        # they follow each other, and more change nothing.
        done: set[tuple[int, int]] = set()
        for batch in batches:
            rows: list[tuple] = []
            for text, cut in zip(batch.column("text").to_pylist(), batch.column("cut").to_pylist(), strict=True):
                b = text_bytes(text)
                mine = [(c["anchor"], c["context"]) for c in cut]
                if done.issuperset(mine):
                    continue
                done = set(mine)
                for c in cut:
                    s, n = c["start"], (c["shape"] & 0xFFFF) + 1
                    rows.append((c["anchor"], c["context"], c["weight"], c["wide"], b[s : s + n - 1 + length]))
                if len(rows) > 10_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    cuts = source.mapInArrow(extract, CUTS)
    return shared, ranges_of(written(cuts, "cuts"), length, [(anchor + length) // 2, length], wide) if n_wide else indexed(cuts, length)


def removed_ranges(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, wide: int = WIDE) -> DataFrame:
    """(doc_id, row, ranges): windows of each text that start anywhere else too, as first and last starts in turn."""
    shared, ranges = repeated_contexts(docs, length, anchor, wide)
    # A context's ranges as one row; contexts that very many places hold meet these apart.
    weights = shared.filter("NOT alike").groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"))
    whole = written(ranges.groupBy("anchor", "context").agg(F.flatten(F.collect_list("ranges")).alias("ranges")).join(weights, ["anchor", "context"]), "ranges")
    places = spread_join(shared.filter("NOT alike").select("doc_id", "row", "start", "anchor", "context"), whole, ["anchor", "context"], "n")
    moved = places.select("doc_id", "row", F.transform("ranges", lambda x: x + F.col("start")).alias("ranges"))
    plain = shared.filter("alike").select("doc_id", "row", F.array(F.col("start"), F.col("start") + F.col("shape").bitwiseAND(0xFFFF)).alias("ranges"))
    return moved.unionByName(plain).groupBy("doc_id", "row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))


def merged_spans(ranges, length: int) -> list[tuple[int, int]]:
    """Byte spans ``[start, stop)`` that the windows cover, apart and in order."""
    if ranges is None or not len(ranges):
        return []
    pairs = np.asarray(ranges, np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    start, stop = pairs[:, 0], np.maximum.accumulate(pairs[:, 1] + length)
    new = np.append(True, start[1:] > stop[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(pairs) - 1)
    return list(zip(start[new].tolist(), stop[last].tolist(), strict=True))


def exact_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, wide: int = WIDE) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the kept bytes' spans.

    Every byte of a text's UTF-8 that a ``length``-byte string covers which also starts anywhere else,
    in the same or another document, is removed; strings are judged on the input. Null texts are empty.
    Texts shorter than ``length`` lose nothing. Repeated rows are documents of their own, so equal texts of
    that length lose all. Null doc_ids are kept apart by their text. Other columns are left alone; an
    empty table gives no rows.
    """
    texts = keyed(docs)
    gone = removed_ranges(docs, length, anchor, wide).withColumnsRenamed({"doc_id": "_d", "row": "_r"})
    both = texts.join(gone, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row") == F.col("_r")), "left").select("doc_id", "text", "ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            values = batch.column("ranges")
            for k, text in enumerate(batch.column("text").to_pylist()):
                b = text_bytes(text)
                spans = merged_spans(values[k].values.to_numpy() if values[k].is_valid else None, length)
                digest, at = hashlib.sha256(), 0
                for s, e in spans:
                    digest.update(b[at:s])
                    at = e
                digest.update(b[at:])
                rows.append((len(b), sum(e - s for s, e in spans), len(spans), digest.hexdigest(), [x for p in spans for x in p]))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return both.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")


def brute_force(texts: list, length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The contract by a table of all windows, for small inputs: n_bytes, n_removed, n_spans, sha."""
    raw = [text_bytes(t) for t in texts]
    seen: dict[bytes, int] = {}
    for b in raw:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for b in raw:
        mask = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                mask[i : i + length] = True
        kept = np.frombuffer(b, np.uint8)[~mask[:-1]].tobytes()
        starts = int((mask[:-1] & ~np.append(False, mask[:-1])[:-1]).sum()) if len(b) else 0
        out.append((len(b), int(mask.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return out
