"""Exact top-k search by inner product over a pivot-distance index.

Vectors are keyed by their nearest pivot and their distance to it. Sorted by that key they are cut into annuli:
blocks of rows of one pivot with a least and a greatest distance. A query looks into its own annulus, then into those of its
own pivot, then into all others, and each time only into those that the triangle inequality doesn't rule out.

An inner product becomes a distance by one more component: with ``M`` the largest norm of all vectors,
``x' = (x, sqrt(M^2 - |x|^2))`` and ``q' = (q, 0)`` it holds ``|q' - x'|^2 = |q|^2 + M^2 - 2 qx``.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oriel.llm.common import with_row_key, written

#: Rows of an annulus and of a tile of queries at most; fewer if they are wide.
BLOCK_ROWS, BLOCK_BYTES = 2048, 8 << 20
#: Pivots: one for so many vectors, this many at most. They are fitted to the rows of the lowest hashes, at most so many.
ROWS_A_PIVOT, MOST_PIVOTS, SAMPLE = 4096, 256, 4096
#: Parts into which the annuli of a pivot are dealt where tiles look for them.
SALTS = 8
#: Tiles of which a task remembers what it has found; each takes 320 bytes a query.
TILES_KNOWN = 64
#: Stands for a vec_id that is null: after all others.
NO_ID = (1 << 63) - 1

CODED = "a long, b long, vec_id long, codes binary, sq double"
KEYED = "a long, b long, vec_id long, codes binary, pivot int, dist double"
BLOCKS = "block long, pivot int, low double, high double, n int, ids binary, dists binary, codes binary"
TILES = "tile long, pivot int, query_ids binary, homes binary, codes binary, scores binary, ids binary"
FOUND = "tile long, q int, query_id long, score long, vec_id long"


def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole-number components of the vectors that take part, 32 bits each, and their squared norms."""
    for batch in batches:
        lists = batch.column("v")
        size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), -1)
        values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        starts = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        codes: list[bytes | None] = [None] * len(size)
        norms = np.zeros(len(size))
        for n in np.unique(size[size >= 0]):
            rows = np.flatnonzero(size == n)
            x = values[starts[rows][:, None] + np.arange(n)]
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(64 * x)
                norms[rows] = (x * x).sum(axis=1)
            good = np.isfinite(norms[rows]) & (norms[rows] < 2.0**62)
            for i, c in zip(rows[good], x[good].astype("<i4"), strict=True):
                codes[i] = c.tobytes()
        keep = np.flatnonzero([c is not None for c in codes])
        rest = [batch.column(c).take(pa.array(keep)) for c in ("a", "b", "vec_id")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array([codes[i] for i in keep], pa.binary()), pa.array(norms[keep])], names=["a", "b", "vec_id", "codes", "sq"])


def matrix(codes: list[bytes], width: int) -> np.ndarray:
    """Rows of components; shorter vectors are filled up with zeros."""
    if all(len(c) == 4 * width for c in codes):
        return np.frombuffer(b"".join(codes), "<i4").reshape(len(codes), width)
    out = np.zeros((len(codes), width), "<i4")
    for i, c in enumerate(codes):
        out[i, : len(c) // 4] = np.frombuffer(c, "<i4")
    return out


def raised(x: np.ndarray, most_sq: float | None) -> np.ndarray:
    """Vectors with their component more; for queries (no ``most_sq``) it is 0."""
    x = x.astype(float)
    last = np.zeros(len(x)) if most_sq is None else np.sqrt(np.maximum(most_sq - (x * x).sum(axis=1), 0))
    return np.hstack([x, last[:, None]])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(d, 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products: floating point where all sums are whole numbers that it holds, else 64-bit numbers."""
    bound = np.sqrt((a.astype(float) ** 2).sum(axis=1).max(initial=0) * (b.astype(float) ** 2).sum(axis=1).max(initial=0))
    kind = np.float32 if bound < 2**23 else np.float64 if bound < 2**52 else np.int64
    return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)


def fit_pivots(sample: np.ndarray, number: int, rounds: int = 6) -> np.ndarray:
    """Farthest points first, then a few rounds of means."""
    centres = [sample[0]]
    near = distances(sample, sample[:1])[:, 0]
    while len(centres) < number and near.max() > 0:
        centres.append(sample[int(near.argmax())])
        near = np.minimum(near, distances(sample, centres[-1][None])[:, 0])
    pivots = np.array(centres)
    for _ in range(rounds):
        own = distances(sample, pivots).argmin(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, own, sample)
        n = np.bincount(own, minlength=len(pivots))[:, None]
        pivots = np.where(n > 0, sums / np.maximum(n, 1), pivots)
    return pivots


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` highest of each row, ties to smaller ids; ``ids`` holds one for each column."""
    order = np.argsort(ids, kind="stable")
    scores, ids = scores[:, order], ids[order]
    if scores.shape[1] > 4 * k:
        cut = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        out = np.full((len(scores), k), -(1 << 62)), np.full((len(scores), k), NO_ID)
        for i, (row, c) in enumerate(zip(scores, cut, strict=True)):
            at = np.flatnonzero(row >= c)
            at = at[np.argsort(-row[at], kind="stable")[:k]]
            out[0][i], out[1][i] = row[at], ids[at]
        return out
    top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(scores, top, axis=1), ids[top]


class Index:
    """What tasks need to know of an index: its pivots, the largest norm, the width of vectors and ``k``."""

    def __init__(self, pivots: np.ndarray, most_sq: float, width: int, k: int, every: int):
        self.pivots, self.most_sq, self.width, self.k, self.every = pivots, most_sq, width, k, every
        self.rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // max(4 * width, 1)))
        #: Distances are sums in floating point; bounds are widened by more than their error.
        self.slack = 1e-5 * (1 + np.sqrt(most_sq))

    def keyed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("codes").to_pylist()
            d = np.vstack([distances(raised(matrix(codes[i : i + self.rows], self.width), self.most_sq), self.pivots) for i in range(0, len(codes), self.rows)] or [np.zeros((0, len(self.pivots)))])
            own = d.argmin(axis=1) if len(d) else np.zeros(0, int)
            columns = [batch.column(c) for c in ("a", "b", "vec_id", "codes")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own.astype("i4")), pa.array(d[np.arange(len(d)), own])], names=["a", "b", "vec_id", "codes", "pivot", "dist"])

    def packed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows as annuli."""
        number, pivot, held = TaskContext.get().partitionId() << 33, -1, []

        def block() -> pa.RecordBatch:
            ids, dists, codes = zip(*held, strict=True)
            row = {"block": number, "pivot": pivot, "low": dists[0], "high": dists[-1], "n": len(held)}
            row |= {"ids": np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes(), "dists": np.array(dists, "<f8").tobytes(), "codes": matrix(list(codes), self.width).tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=BLOCK_SCHEMA)

        for batch in batches:
            for p, *row in zip(*(batch.column(c).to_pylist() for c in ("pivot", "vec_id", "dist", "codes")), strict=True):
                if held and (p != pivot or len(held) >= self.rows):
                    yield block()
                    number += 1
                    held = []
                pivot = p
                held.append(row)
        if held:
            yield block()

    def opened(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["dists"], "<f8"), np.frombuffer(row["codes"], "<i4").reshape(-1, self.width)

    def tiles(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of annuli of one pivot, with the best rows of each query's own annulus."""
        number, pivot, held = TaskContext.get().partitionId() << 33, -1, []

        def tile() -> Iterator[pa.RecordBatch]:
            nonlocal number
            parts = [np.concatenate(x) for x in zip(*held, strict=True)]
            for i in range(0, len(parts[0]), self.rows):
                row = dict(zip(("query_ids", "homes", "codes", "scores", "ids"), (x[i : i + self.rows].tobytes() for x in parts), strict=True))
                yield pa.RecordBatch.from_pylist([{"tile": number, "pivot": pivot} | row], schema=TILE_SCHEMA)
                number += 1

        for batch in batches:
            for row in batch.to_pylist():
                ids, _, codes = self.opened(row)
                at = np.flatnonzero((ids % self.every == 0) & (ids != NO_ID))
                if not len(at):
                    continue
                if held and (row["pivot"] != pivot or sum(len(x[0]) for x in held) >= self.rows):
                    yield from tile()
                    held = []
                pivot = row["pivot"]
                scores, found = np.full((len(at), self.k), -(1 << 62)), np.full((len(at), self.k), NO_ID)
                for i in range(0, len(at), 256):
                    part = at[i : i + 256]
                    s = products(codes[part], codes)
                    s[np.arange(len(part)), part] = -(1 << 62)  # a query's own row
                    top, which = best(s, ids, self.k)
                    scores[i : i + 256, : top.shape[1]], found[i : i + 256, : top.shape[1]] = top, which
                held.append((ids[at], np.full(len(at), row["block"]), codes[at], scores, found))
        if held:
            yield from tile()

    def query_tile(self, row: dict) -> tuple[np.ndarray, ...]:
        """ids, home annuli, components, and the best scores of each query so far with their ids."""
        ids, homes = np.frombuffer(row["query_ids"], "<i8"), np.frombuffer(row["homes"], "<i8")
        codes = np.frombuffer(row["codes"], "<i4").reshape(len(ids), self.width)
        return ids, homes, codes, np.frombuffer(row["scores"], "<i8").reshape(len(ids), self.k), np.frombuffer(row["ids"], "<i8").reshape(len(ids), self.k)

    def reach(self, codes: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The radius around each query that holds all rows of ``score`` or more."""
        r = np.sqrt(np.maximum((codes.astype(float) ** 2).sum(axis=1) + self.most_sq - 2.0 * score, 0)) + self.slack
        return np.where(score == -(1 << 62), np.inf, r)

    def reached(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each tile and pivot the distances to it at which rows could still win."""
        for batch in batches:
            for row in batch.to_pylist():
                _, _, codes, scores, _ = self.query_tile(row)
                d, reach = distances(raised(codes, None), self.pivots), self.reach(codes, scores[:, -1])
                yield pa.RecordBatch.from_pydict(
                    {"tile": [row["tile"]] * len(self.pivots), "own": [row["pivot"]] * len(self.pivots), "pivot": np.arange(len(self.pivots), dtype="i4"), "least": (d - reach[:, None]).min(axis=0), "most": (d + reach[:, None]).max(axis=0)},
                    schema=REACH_SCHEMA,
                )

    def searched(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of annuli that belong to the best of a query as far as the task knows: of each query's reach only, ``k`` at
        most. What a task has found narrows the reach in its next annuli; it remembers the last ``TILES_KNOWN`` tiles."""
        known: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()
        for batch in batches:
            for row in batch.to_pylist():
                ids, homes, codes, scores, found = self.query_tile(row)
                if row["tile"] not in known:
                    known[row["tile"]] = scores.copy(), found.copy()
                    if len(known) > TILES_KNOWN:
                        known.popitem(last=False)
                known.move_to_end(row["tile"])
                scores, found = known[row["tile"]]
                rows, dists, x = self.opened({"ids": row["b_ids"], "dists": row["b_dists"], "codes": row["b_codes"]})
                reach = self.reach(codes, scores[:, -1])
                d = distances(raised(codes, None), self.pivots[row["b_pivot"]][None])[:, 0]
                first, stop = np.searchsorted(dists, d - reach, "left"), np.searchsorted(dists, d + reach, "right")
                open_ = np.flatnonzero((first < stop) & (homes != row["block"]))
                for i in range(0, len(open_), 256):
                    q = open_[i : i + 256]
                    a, z = first[q].min(), stop[q].max()
                    s = products(codes[q], x[a:z])
                    near = np.arange(a, z)
                    score, last = scores[q, -1][:, None], found[q, -1][:, None]
                    wins = (s > score) | (s == score) & (rows[a:z] < last)
                    wins &= (near >= first[q][:, None]) & (near < stop[q][:, None])
                    some = wins.any(axis=1)
                    if not some.any():
                        continue
                    q = q[some]
                    top, which = best(np.where(wins[some], s[some], -(1 << 62)), rows[a:z], self.k)
                    at = np.repeat(q, top.shape[1])
                    there = top.reshape(-1) > -(1 << 62)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(there.sum(), row["tile"])), pa.array(at[there].astype("i4")), pa.array(ids[at[there]]), pa.array(top.reshape(-1)[there]), pa.array(which.reshape(-1)[there])],
                        schema=FOUND_SCHEMA,
                    )
                    all_scores, all_ids = np.hstack([scores[q], top]), np.hstack([found[q], np.where(top > -(1 << 62), which, NO_ID)])
                    order = np.lexsort((all_ids, -all_scores))[:, : self.k]
                    scores[q], found[q] = np.take_along_axis(all_scores, order, axis=1), np.take_along_axis(all_ids, order, axis=1)

    def listed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What tiles know, a row for each query and place."""
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["query_ids"], "<i8")
                scores, found = np.frombuffer(row["scores"], "<i8"), np.frombuffer(row["ids"], "<i8")
                at = np.repeat(np.arange(len(ids)), len(scores) // max(len(ids), 1))
                there = scores > -(1 << 62)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(there.sum(), row["tile"])), pa.array(at[there].astype("i4")), pa.array(ids[at[there]]), pa.array(scores[there]), pa.array(found[there])], schema=FOUND_SCHEMA)

    def told(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Tiles with the best rows of each query as found since (``news``: q, rank, score, vec_id)."""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                news = row.pop("news") or []
                shape = len(row["query_ids"]) // 8, self.k
                scores, found = np.full(shape, -(1 << 62)), np.full(shape, NO_ID)
                for x in news:
                    scores[x["q"], x["rank"] - 1], found[x["q"], x["rank"] - 1] = x["score"], x["vec_id"]
                out.append(row | {"scores": scores.tobytes(), "ids": found.tobytes()})
            yield pa.RecordBatch.from_pylist(out, schema=TILE_SCHEMA)


BLOCK_SCHEMA = pa.schema([("block", pa.int64()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int32()), ("ids", pa.binary()), ("dists", pa.binary()), ("codes", pa.binary())])
TILE_SCHEMA = pa.schema([("tile", pa.int64()), ("pivot", pa.int32()), *((c, pa.binary()) for c in ("query_ids", "homes", "codes", "scores", "ids"))])
REACH_SCHEMA = pa.schema([("tile", pa.int64()), ("own", pa.int32()), ("pivot", pa.int32()), ("least", pa.float64()), ("most", pa.float64())])
FOUND_SCHEMA = pa.schema([("tile", pa.int64()), ("q", pa.int32()), ("query_id", pa.int64()), ("score", pa.int64()), ("vec_id", pa.int64())])


def top_of_each(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("tile", "q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 20, every: int = 20) -> DataFrame:
    """Of each query the ``k`` other rows of the highest inner products of floor(64 * x): query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``. Ties go to smaller ids. Exact: bounds only leave out rows that can't
    be among the best.

    A vector that is null or holds a null or non-finite component takes no part, nor does one whose squared norm reaches
    2^62, as its scores might not fit; an empty one scores 0. Of vectors of different lengths the missing
    components are 0. A row without id is no query, and as a candidate comes after all others of its score, with a null
    ``vec_id``. Rows that share an id are queries and candidates of their own: each leaves out only itself. An empty
    table gives no row, a single vector neither.
    """
    numbered, a, b = with_row_key(vectors)
    source = numbered.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    coded = written(source.mapInArrow(encode, CODED), "coded")
    figures = coded.agg(F.count(F.lit(1)).alias("n"), F.max("sq").alias("sq"), F.max(F.octet_length("codes")).alias("bytes")).first()
    n, width = figures["n"], (figures["bytes"] or 0) // 4
    sample = coded.orderBy(F.xxhash64("a", "b"), "a", "b").select("codes").limit(max(1, min(SAMPLE, (64 << 20) // max(8 * width, 1)))).collect()
    points = raised(matrix([bytes(r["codes"]) for r in sample], width), figures["sq"] or 0.0) if sample else np.zeros((1, width + 1))
    index = Index(fit_pivots(points, max(1, min(MOST_PIVOTS, n // ROWS_A_PIVOT))), figures["sq"] or 0.0, width, k, every)

    keyed = coded.drop("sq").mapInArrow(index.keyed, KEYED)
    parts = max(1, min(1 << 20, n // (4 * index.rows)))
    ordered = keyed.repartitionByRange(parts, "pivot", "dist", "a", "b").sortWithinPartitions("pivot", "dist", "a", "b")
    blocks = written(ordered.mapInArrow(index.packed, BLOCKS), "annuli")
    tiles = written(blocks.mapInArrow(index.tiles, TILES), "tiles")
    found = tiles.mapInArrow(index.listed, FOUND)

    salted = blocks.select("block", F.col("pivot").alias("pivot"), "low", "high", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int").alias("salt"))
    contents = blocks.select("block", F.col("pivot").alias("b_pivot"), F.col("ids").alias("b_ids"), F.col("dists").alias("b_dists"), F.col("codes").alias("b_codes"))

    def ring(now: DataFrame, own: bool) -> DataFrame:
        reach = now.mapInArrow(index.reached, "tile long, own int, pivot int, least double, most double")
        reach = reach.filter((F.col("own") == F.col("pivot")) == F.lit(own)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = reach.join(salted, ["pivot", "salt"]).filter("high >= least AND low <= most").select("tile", "block")
        return pairs.join(now, "tile").drop("pivot").join(contents, "block").mapInArrow(index.searched, FOUND)

    near = written(top_of_each(found.unionByName(ring(tiles, True)), k), "nearest")
    last = near.groupBy("tile").agg(F.collect_list(F.struct("q", "rank", "score", "vec_id")).alias("news"))
    sharper = written(tiles.join(last, "tile", "left").mapInArrow(index.told, TILES), "sharper")
    out = top_of_each(near.drop("rank").unionByName(ring(sharper, False)), k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


def brute_force(vectors: list[tuple[int | None, list | None]], k: int = 20, every: int = 20) -> list[tuple]:
    """The same by comparing each query with all rows, for tests."""
    rows = [(i, np.floor(64 * np.array(v, float)).tolist()) for i, v in vectors if v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    rows = [(i, [int(c) for c in v]) for i, v in rows if sum(c * c for c in v) < 2**62]
    out = []
    for at, (i, v) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), NO_ID if j is None else j) for p, (j, w) in enumerate(rows) if p != at)
        out += [(i, r + 1, None if j == NO_ID else j, -s) for r, (s, j) in enumerate(scored[:k])]
    return out
