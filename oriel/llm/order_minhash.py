"""Near-duplicate classes by Order MinHash over five-word shingles, verified by banded alignment."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oriel.llm.common import drop_table, free_name, mix64, spread_join, written
from oriel.llm.graph import components

SHINGLE_WORDS = 5
#: Sketches of a text, and k-mers that each keeps in text order. At a similarity of 0.8 a sketch agrees
#: with a probability of about 0.51, so that all 16 differ with one of about 1 in 100,000.
SKETCHES, KEPT = 16, 3
SIMILARITY = 0.8

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = mix64(np.arange(1, 257, dtype=_U)) | _U(1)
#: A random value for each byte at each of the first places of a word; later places are mixed as they come.
_PLACES = 48
_VALUES = mix64(mix64(np.arange(1, _PLACES * 256 + 1, dtype=_U)) + _U(0x9E3779B97F4A7C15))


def byte_values(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A random value for each byte of ``data`` at its place ``at`` in its word, alike for all texts."""
    near = at < _PLACES
    out = _VALUES[np.where(near, at, 0) * 256 + data]
    if not near.all():
        far = np.flatnonzero(~near)
        out[far] = mix64(mix64(at[far].astype(_U) * _U(256) + data[far].astype(_U)) + _U(0xD1B54A32D192ED03))
    return out


def word_hashes(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words of ``texts``, in order, and the number of words of each text.

    Words lie between ASCII white space. A word's hash mixes the sum of random values, one for each of its bytes
    by the byte and its place; unlike sums of powers, no regular pattern of bytes cancels out.
    """
    raw = [b"" if t is None else t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[data]
    inside = ~space
    start = inside.copy()
    start[1:] &= space[:-1]
    first = np.flatnonzero(start)
    n_words = np.zeros(len(texts), np.int64)
    if not len(first):
        return np.empty(0, _U), n_words
    lengths = np.array([len(b) + 1 for b in raw], np.int64)
    begin = np.cumsum(lengths) - lengths
    n_words = np.diff(np.append(np.searchsorted(first, begin), len(first)))
    stop = np.flatnonzero(space & np.append(False, inside[:-1]))
    size = stop - first
    letters = np.flatnonzero(inside)
    ends = np.cumsum(size)
    at = np.arange(len(letters)) - np.repeat(ends - size, size)
    return mix64(np.add.reduceat(byte_values(data[letters], at), ends - size) + size.astype(_U)), n_words


#: Bytes of text that are hashed at once, if no text alone has more; memory follows this, not the batch.
HASHED_BYTES = 1 << 18


def slices(sizes: list[int], most: int = HASHED_BYTES) -> Iterator[tuple[int, int]]:
    """Runs (start, stop) of items that have ``most`` bytes together, or one item that has more."""
    i = 0
    while i < len(sizes):
        j, total = i, 0
        while j < len(sizes) and (j == i or total + sizes[j] <= most):
            total += sizes[j]
            j += 1
        yield i, j
        i = j


def shingle_labels(hashes: np.ndarray, n_words: np.ndarray, k: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-word shingles of all texts, in order, and how many each text has.

    Equal shingles of one text get different labels, by their number. A text of fewer than k words
    but some has one shingle, of all its words.
    """
    n_shingles = np.where(n_words == 0, 0, np.maximum(1, n_words - k + 1))
    total = int(n_shingles.sum())
    if not total:
        return np.empty(0, _U), n_shingles
    text_of = np.repeat(np.arange(len(n_words)), n_shingles)
    word_first = np.cumsum(n_words) - n_words
    at = np.arange(total) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles) + word_first[text_of]
    last = (word_first + n_words - 1)[text_of]
    out = np.zeros(total, _U)
    for j in range(k):
        out = out * _U(0xD6E8FEB86659FD93) + np.where(at + j <= last, hashes[np.minimum(at + j, last)], _U(0))
    out = mix64(out)
    own = out + text_of.astype(_U) * _U(0x9E3779B97F4A7C15)
    order = np.argsort(own, kind="stable")
    ordered = own[order]
    new = np.ones(total, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.arange(total) - np.maximum.accumulate(np.where(new, np.arange(total), 0))
    occurrence = np.empty(total, np.int64)
    occurrence[order] = number
    repeated = occurrence > 0
    out[repeated] = mix64(out[repeated] + occurrence[repeated].astype(_U) * _U(0xA0761D6478BD642F))
    return out, n_shingles


def sketches(labels: np.ndarray, n_shingles: np.ndarray, count: int = SKETCHES, kept: int = KEPT) -> tuple[np.ndarray, np.ndarray]:
    """``count`` keys for each text that has shingles: each hashes the ``kept`` labels that come first
    under one random order, in the order in which they stand in the text. And ``count * kept`` bytes,
    one of each such label by its rank, which tell how alike two texts are.
    """
    some = np.flatnonzero(n_shingles)
    n = n_shingles[some]
    first = np.cumsum(n) - n
    out, lanes = np.empty((len(some), count), _U), np.zeros((len(some), count * kept), np.uint8)
    if not len(some):
        return out, lanes
    # Values below a bound that about 24 of a text's labels meet; the few texts of which too few do are looked at whole.
    bound = np.repeat(np.where(n <= 32, _U(0xFFFFFFFFFFFFFFFF), (2.0**64 * 24 / np.maximum(n, 33)).astype(_U)), n)
    text_of = np.repeat(np.arange(len(some)), n)
    need = np.minimum(n, kept)
    for j in range(count):
        value = labels * _ODD[j]
        value ^= value >> _U(29)
        at = np.flatnonzero(value <= bound)
        got = np.bincount(text_of[at], minlength=len(some))
        for t in np.flatnonzero(got < need):
            at = np.union1d(at, np.arange(first[t], first[t] + n[t]))
        order = np.lexsort((value[at], text_of[at]))
        at = at[order]
        owner = text_of[at]
        begin = np.searchsorted(owner, np.arange(len(some)))
        place = np.arange(len(at)) - begin[owner]
        low = place < kept
        lanes[owner[low], j * kept + place[low]] = (labels[at[low]] >> _U(40)).astype(np.uint8)
        chosen = np.sort(at[low])  # text order
        owner = text_of[chosen]
        begin = np.searchsorted(owner, np.arange(len(some)))
        place = np.arange(len(chosen)) - begin[owner]
        key = np.full(len(some), j + 1, _U)
        for p in range(kept):
            mine = place == p
            key[owner[mine]] = mix64(key[owner[mine]] * _U(0xE7037ED1A0B428DB) + labels[chosen[mine]])
        out[:, j] = key
    return out, lanes


def aligned_similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity of two label sequences by banded alignment: aligned / (len(a) + len(b) - aligned).

    The alignment is a longest common subsequence. As labels are unique in a text, it is the longest
    increasing run of places. Texts as similar as ``least`` leave at most (1 - least) / (1 + least) of
    their labels unmatched, so their matches lie within that band. 0 is returned as soon as a
    similarity of ``least`` is out of reach.
    """
    total = len(a) + len(b)
    if not total:
        return 0.0
    need = least * total / (1 + least) - 1e-9
    if min(len(a), len(b)) < need:
        return 0.0
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sa, sb = a[oa], b[ob]
    at = np.minimum(np.searchsorted(sb, sa), len(sb) - 1)
    same = sb[at] == sa
    i, j = oa[same], ob[at[same]]
    near = np.abs(i - j) <= total * (1 - least) / (1 + least) + 1
    i, j = i[near], j[near]
    if len(i) < need:
        return 0.0
    j = j[np.argsort(i)]
    if len(j) > 1 and not (np.diff(j) > 0).all():
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        n = len(tails)
    else:
        n = len(j)
    return n / (total - n)


#: Texts, picked by hash, whose labels tell which labels are common, and common labels that are told at most.
SAMPLED_TEXTS, COMMON_LABELS = 20_000, 400_000


def common_labels(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Labels that stand in several of about ``SAMPLED_TEXTS`` different texts, sorted, and in how many they
    stand. They only make the order of labels good: any order is exact.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
                labels, _ = shingle_labels(*word_hashes(batch.column("text").slice(i, j - i).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(labels.view(np.int64))], names=["label"])

    each = max(1, docs.count() // SAMPLED_TEXTS)
    some = docs.filter(F.pmod("k1", F.lit(each)) == 0).select("text").distinct()
    counts = written(some.mapInArrow(label, "label long").groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "common")
    # The commonest ones, whole levels of n at a time; there are no more levels than sampled texts.
    least, held = 2, 0
    for level in counts.groupBy("n").agg(F.count(F.lit(1)).alias("labels")).orderBy(F.col("n").desc()).collect():
        held += level["labels"]
        if held > COMMON_LABELS:
            least = level["n"] + 1
            break
    rows = counts.filter(F.col("n") >= least).toArrow()
    drop_table(counts)
    labels, n = rows["label"].to_numpy().view(_U), rows["n"].to_numpy()
    order = np.argsort(labels)
    return labels[order], n[order]


#: Labels up to which parities tell texts apart, and labels beyond it for each further one that two texts must share.
SHORT, FURTHER = 256, 64


def least_shared(n):
    """How many of their rare labels two texts of a similarity of 0.8 share at least, if the smaller one has ``n`` labels (an array or a column).

    One alone is no sign in long texts: each has a fifth of its labels among its rare ones, and so most of them share one by chance.
    """
    over = np.maximum(n - SHORT, 0) if isinstance(n, np.ndarray) else F.greatest(n - SHORT, F.lit(0))
    return over // FURTHER + 1 if isinstance(n, np.ndarray) else F.floor(over / FURTHER) + 1


def rare_prefixes(labels: np.ndarray, n_shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The labels of each text that come first when rare ones lead, and how many of them each text has.

    Two texts of a similarity of 0.8 share at least 4/5 of the labels of either. So the first k labels that they
    share are among the first n - ceil(4n / 5) + k of both, in any order that is the same for all texts; k is ``least_shared``.
    """
    text_of = np.repeat(np.arange(len(n_shingles)), n_shingles)
    count = np.zeros(len(labels), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, labels), len(common) - 1)
        count = np.where(common[at] == labels, counts[at], 0)
    order = np.lexsort((labels, count, text_of))
    size = np.where(n_shingles > 0, np.minimum(n_shingles, n_shingles - (4 * n_shingles + 4) // 5 + least_shared(n_shingles)), 0)
    place = np.arange(len(labels)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles)
    return labels[order][place < size[text_of]], size


#: 64-bit words of a text's parity bits.
PARITY_WORDS = 4


def parities(labels: np.ndarray, n_shingles: np.ndarray) -> np.ndarray:
    """For each text that has labels the parity of how many fall on each of 256 bits. Two texts differ in at
    least as many labels as they differ in bits."""
    some = n_shingles > 0
    first = (np.cumsum(n_shingles) - n_shingles)[some]
    out = np.zeros((len(first), PARITY_WORDS), _U)
    bit = _U(1) << ((labels >> _U(11)) & _U(63))
    word = (labels >> _U(17)) & _U(PARITY_WORDS - 1)
    for k in range(PARITY_WORDS if len(first) else 0):
        out[:, k] = np.bitwise_xor.reduceat(np.where(word == k, bit, _U(0)), first)
    return out


PARITIES = [f"p{k}" for k in range(PARITY_WORDS)]
FEATURES = f"k1 long, k2 long, doc_id long, h1 long, h2 long, n_shingles int, keys array<long>, lanes binary, prefix array<long>, {', '.join(f'{p} long' for p in PARITIES)}"


def features(docs: DataFrame, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """k1, k2 and doc_id as they are, two hashes of the words, number of shingles, sketch keys, lanes, rare labels and
    parities; null where there are no words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()):
                yield batch.slice(i, j - i)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            hashes, n_words = word_hashes(batch.column("text").to_pylist())
            labels, n = shingle_labels(hashes, n_words)
            keys, lanes = sketches(labels, n)
            some = n > 0
            first = (np.cumsum(n_words) - n_words)[some]
            place = np.arange(len(hashes)) - np.repeat(first, n_words[some])
            both = []
            for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
                h = np.zeros(len(n), _U)
                if len(first):
                    h[some] = np.add.reduceat(mix64(hashes + place.astype(_U) * _U(salt)), first)
                both.append(pa.array(h.view(np.int64), mask=~some))
            spread = np.zeros(len(n) + 1, np.int32)
            spread[1:] = np.cumsum(some * SKETCHES)
            key_lists = pa.ListArray.from_arrays(pa.array(spread), pa.array(keys.reshape(-1).view(np.int64)))
            lane_rows = iter(lanes)
            rare, sizes = rare_prefixes(labels, n, common, counts)
            rare_lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(rare.view(np.int64)))
            bits = np.zeros((len(n), PARITY_WORDS), np.int64)
            bits[some] = parities(labels, n).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("k1", "k2", "doc_id")), *both, pa.array(n.astype(np.int32)), key_lists, pa.array([next(lane_rows).tobytes() if x else None for x in some], pa.binary()), rare_lists, *(pa.array(bits[:, k].copy()) for k in range(PARITY_WORDS))],
                names=["k1", "k2", "doc_id", "h1", "h2", "n_shingles", "keys", "lanes", "prefix", *PARITIES],
            )

    return docs.select("k1", "k2", "doc_id", "text").mapInArrow(make, FEATURES)


def keyed(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, text): 128 bits that tell different rows apart by doc_id and text, nulls too."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(7), "text", F.coalesce("doc_id", F.lit(-1))).alias("k2"), "doc_id", "text")


#: Single texts, as three numbers each, that are sent to all tasks at most, instead of a shuffle of all texts.
BROADCAST_ROWS = 200_000
#: Rows of a bucket that are compared with each other at once; larger buckets are dealt into such
#: blocks at random, differently for each sketch and round.
BLOCK = 1024
#: Partners that each text proposes in each round in a bucket of up to ``SMALL`` texts; in a larger one
#: it proposes one (the hub first), as it meets the same family in many buckets. And lanes that must agree: at a
#: similarity of 0.8 about 31 of 48 do, with a deviation of about 4.
PARTNERS, SMALL, LEAST_LANES = 3, 8, 14


def nearest(node: np.ndarray, group: np.ndarray, size: np.ndarray, lanes: np.ndarray, number: int, tested: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each text of a block partners of other groups, as pairs (low, high): its most alike ones but
    those that it was ``tested`` with (a list for each text, or null). In a large block the first round proposes the hub instead, the text that is most
    alike to all others, as copies with separate edits are nearest to what they were made from.

    Texts of the largest group, if it has several, don't propose: the others propose to them.
    """
    n = len(node)
    names, counts = np.unique(group, return_counts=True)
    asks = group != names[counts.argmax()] if counts.max() > 1 else np.ones(n, bool)
    score = np.zeros((n, n), np.int16)
    for k in range(lanes.shape[1]):
        score += lanes[:, k, None] == lanes[None, :, k]
    alike = score.sum(1, dtype=np.int64)
    ratio = np.minimum(size[:, None], size[None, :]) / np.maximum(size[:, None], size[None, :])
    score[(group[:, None] == group[None, :]) | (ratio < SIMILARITY)] = -1
    rows = np.arange(n)
    at = {x: i for i, x in enumerate(node.tolist())} if tested else {}
    for i, others in enumerate(tested or []):
        for x in others or ():
            if (j := at.get(x)) is not None:
                score[i, j] = -1
    left, right = [], []

    def propose(partner: np.ndarray):
        good = asks & (score[rows, partner] >= LEAST_LANES)
        left.append(node[good])
        right.append(node[partner[good]])

    if n > SMALL and number == 0:
        propose(np.full(n, alike.argmax()))
    else:
        for _ in range(min(PARTNERS if n <= SMALL else 1, n - 1)):
            best = score.argmax(1)
            propose(best)
            score[rows, best] = -1
    a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
    return np.minimum(a, b), np.maximum(a, b)


def by_blocks(batches: Iterator[pa.RecordBatch], found) -> Iterator[pa.RecordBatch]:
    """``found`` of runs of whole blocks; rows are sorted by block."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        block = held["block"].to_numpy()
        whole = int(np.searchsorted(block, block[-1])) if len(block) else 0  # the last block may go on
        if whole:
            yield found(held.slice(0, whole).combine_chunks())
            held = held.slice(whole)
    if held is not None and held.num_rows:
        yield found(held.combine_chunks())


def proposals(members: DataFrame, number: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, that the blocks of ``members`` (block, node, group, n, lanes, tested) propose."""
    width = SKETCHES * KEPT

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: pa.Table) -> pa.RecordBatch:
            block = rows["block"].to_numpy()
            edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
            node, group, size = rows["node"].to_numpy(), rows["group"].to_numpy(), rows["n"].to_numpy().astype(float)
            lanes = np.frombuffer(b"".join(rows["lanes"].to_pylist()), np.uint8).reshape(-1, width)
            tested = rows["tested"].to_pylist()
            out = []
            for x, y in zip(edges, np.append(edges[1:], len(block)), strict=True):
                if y - x > 1 and (group[x:y] != group[x]).any():
                    out.append(nearest(node[x:y], group[x:y], size[x:y], lanes[x:y], number, tested[x:y]))
            a, b = (np.concatenate([p[k] for p in out]) if out else np.empty(0, np.int64) for k in (0, 1))
            both = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])

        return by_blocks(batches, found)

    dealt = members.repartition("block").sortWithinPartitions("block", "node").select("block", "node", "group", "n", "lanes", "tested")
    return dealt.mapInArrow(propose, "a long, b long").distinct()


#: Pairs of a block that are looked at together; memory follows this, not the block.
LOOKED_AT = 1 << 20


def rare_pairs(block: np.ndarray, node: np.ndarray, group: np.ndarray, size: np.ndarray, place: np.ndarray, part: np.ndarray, bits: np.ndarray, counted: bool = False) -> np.ndarray:
    """Pairs (low, high) of one block and of different groups that may have a similarity of 0.8, by sizes, by
    the places of the shared label and by the parities ``bits`` (rows x words); if ``counted``, with the number of blocks that they meet in.
    Rows come in any order; a ``part`` of -1 meets its like. What fails is never listed: a row looks only at those of its block whose sizes its
    place allows, ``LOOKED_AT`` pairs at a time.
    """
    order = np.lexsort((size, block))
    block, node, group, size, place, part, bits = (x[order] for x in (block, node, group, size, place, part, bits))
    # At least 4/9 of the labels of both are shared, and no more than follow the first shared one: 9 (n - place) >= 4 (n + m). The last
    # of those that must be shared has all but one of them before it.
    most = np.minimum(5 * size - 9 * (place - least_shared(size) + 1), 5 * size) // 4
    span = int(size.max(initial=0)) + 2
    number = np.cumsum(np.append(0, block[1:] != block[:-1])) if len(block) else np.empty(0, np.int64)
    stop = np.searchsorted(number * span + size, number * span + np.clip(most, -1, span - 1), side="right")
    many = np.maximum(0, stop - np.arange(len(block)) - 1)
    out, x, ends = [], 0, np.cumsum(many)
    while x < len(block):
        before = ends[x] - many[x]
        y = max(x + 1, int(np.searchsorted(ends, before + LOOKED_AT, side="right")))
        i = np.repeat(np.arange(x, y), many[x:y])
        j = i + 1 + np.arange(len(i)) - np.repeat(ends[x:y] - many[x:y] - before, many[x:y])
        x = y
        good = (group[i] != group[j]) & ((part[i] != part[j]) | (part[i] < 0)) & (size[i] <= most[j])
        i, j = i[good], j[good]
        apart = np.zeros(len(i), np.int64)
        for k in range(bits.shape[1]):
            apart += np.bitwise_count(bits[i, k] ^ bits[j, k])
        good = 9 * apart <= size[i] + size[j]
        i, j = i[good], j[good]
        if len(i):
            out.append(summed(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), np.ones(len(i), np.int64)], 1)))
    both = summed(np.concatenate(out)) if out else np.empty((0, 3), np.int64)
    return both if counted else both[:, :2]


def summed(pairs: np.ndarray) -> np.ndarray:
    """Distinct pairs of ``pairs`` (rows of low, high, number) with the sums of their numbers."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
    first = np.flatnonzero(np.append(True, (pairs[1:, :2] != pairs[:-1, :2]).any(1)))
    return np.column_stack([pairs[first, :2], np.add.reduceat(pairs[:, 2], first)])


#: Sizes of one band differ by this factor at most, so texts of a similarity of 0.8 lie in one band or in neighbours.
BAND = 1.2501
#: Labels that hold over 1 / HOT_LABELS of all rows of labels are met apart; so there are no more than this.
HOT_LABELS = 1000
#: Items that the sketch of frequent labels tracks: it misses none that holds over 4 / TRACKED of the rows.
TRACKED = 16_384


def hot_labels(rows: DataFrame) -> DataFrame:
    """(label) of at most ``HOT_LABELS`` labels: all that over a thousandth of ``rows``, and over ``BLOCK`` of them, hold.
    Found by one sketch of frequent items, summed up before the shuffle, and then counted."""
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(label, {2 * HOT_LABELS}, {TRACKED})").alias("top")).first()
    least = max(BLOCK, got["n"] // HOT_LABELS)
    near = [(x["item"],) for x in got["top"] or () if x["count"] > least]
    return rows.sparkSession.createDataFrame(near, "label long").coalesce(1)


def dealt(rows: DataFrame) -> DataFrame:
    """Blocks of ``rows`` (label, node, group, n, place, bits) of labels that over ``BLOCK`` nodes hold and that join groups.

    A label's rows fall into bands of sizes and these into parts of about ``BLOCK`` rows. Each part meets those of its own band
    and of the two bands beside it, in blocks of two parts. So a block is bounded, and every pair whose sizes
    allow a similarity of 0.8 meets.
    """
    banded = rows.withColumn("band", F.floor(F.log("n") / F.log(F.lit(BAND))).cast("int"))
    bands = banded.groupBy("label", "band").agg(F.count(F.lit(1)).alias("in_band"), F.min("group").alias("low"), F.max("group").alias("high"))
    sizes = F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("in_band") / BLOCK).cast("int").alias("parts")))).alias("parts")
    labels = bands.groupBy("label").agg(F.sum("in_band").alias("of_label"), F.min("low").alias("low"), F.max("high").alias("high"), sizes)
    labels = written(labels.filter("low < high").drop("low", "high"), "labels")
    met = spread_join(banded, labels, ["label"], "of_label")
    met = met.withColumn("own", F.pmod(F.xxhash64("node", "label"), F.element_at("parts", F.col("band"))).cast("int"))

    def meet(step: int):
        """(low band, low part, high part, part) of the row's meetings with the band ``step`` away."""
        others = F.coalesce(F.try_element_at("parts", F.col("band") + step), F.lit(0))
        numbers = F.filter(F.sequence(F.lit(0), others), lambda q: q < others)
        low, high = {0: (F.least, F.greatest), 1: (lambda p, q: p, lambda p, q: q), -1: (lambda p, q: q, lambda p, q: p)}[step]
        part = (lambda q: F.when(q == F.col("own"), -1).otherwise(F.col("own"))) if step == 0 else lambda q: F.lit(step + 1)
        return F.transform(numbers, lambda q: F.struct((F.col("band") + min(step, 0)).alias("base"), F.lit(abs(step)).alias("step"), low(F.col("own"), q).alias("x"), high(F.col("own"), q).alias("y"), part(q).cast("int").alias("part")))

    met = met.withColumn("meeting", F.explode(F.concat(meet(0), meet(1), meet(-1))))
    return met.select(F.xxhash64("label", "meeting.base", "meeting.step", "meeting.x", "meeting.y").alias("block"), "node", "group", "n", "place", "meeting.part", *BITS)


#: Parity bits that rows of labels carry: the four words folded to two, as a bit of two parities' sum is a parity too.
BITS = ["q0", "q1"]


#: Rows of labels that are shuffled at once, and parts of all of them at most: no more of them lies on disk together.
LABEL_ROWS, LABEL_SLICES = 4_000_000, 8


def rest_of_pairs(nodes: DataFrame, scratch: list[DataFrame] | None = None) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ``nodes`` (node, group, n, prefix, parities) of different groups: all
    that may have a similarity of 0.8, as they share enough of their rare labels and differ in few parity bits.

    Nodes meet by label. How many nodes hold a label, and whether they are of several groups, is counted exactly, in the shuffle
    that brings them together, a slice of all labels at a time; labels that hold over a thousandth of all rows don't go through it. Labels of one
    group, those of one node among them, end there. Those of up to ``BLOCK`` nodes are a block, larger ones are ``dealt``.
    Pairs are made after sizes, places and 128 parity bits are compared; the labels that each shares are counted, and 256 bits are then looked at once.
    Tables that the pairs are read from are added to ``scratch``.
    """

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(rows: pa.Table) -> pa.RecordBatch:
            block, node, group, n, place, part = (rows[c].to_numpy().astype(np.int64) for c in ("block", "node", "group", "n", "place", "part"))
            both = rare_pairs(block, node, group, n, place, part, np.stack([rows[c].to_numpy().view(_U) for c in BITS], 1), counted=True)
            return pa.RecordBatch.from_arrays([pa.array(both[:, k].copy()) for k in range(3)], names=["a", "b", "shared"])

        return by_blocks(batches, found)

    scratch = [] if scratch is None else scratch
    bits = [F.col(f"p{k}").bitwiseXOR(F.col(f"p{k + 2}")).alias(b) for k, b in enumerate(BITS)]
    rows = nodes.select("node", "group", "n", F.posexplode("prefix").alias("place", "label"), *bits)
    hot = F.broadcast(hot_labels(rows))
    own = Window.partitionBy("label")
    columns = ["label", "node", "group", "n", "place", *BITS]
    total = nodes.agg(F.coalesce(F.sum(F.size("prefix")), F.lit(0)).alias("n")).first()["n"]
    parts = min(LABEL_SLICES, 1 + total // LABEL_ROWS)
    met = None
    for number in range(parts):
        some = rows.filter(F.pmod("label", F.lit(parts)) == number).join(hot, "label", "left_anti")
        counted = some.select("*", F.count(F.lit(1)).over(own).alias("members"), F.min("group").over(own).alias("low"), F.max("group").over(own).alias("high"))
        shared = written(counted.filter("low < high").select(*columns, "members"), "met")
        scratch.append(shared)
        met = shared if met is None else met.unionByName(shared)
    cold = met.filter(F.col("members") <= BLOCK).select(F.col("label").alias("block"), *columns[1:], F.lit(-1).alias("part"))
    found = cold.repartition("block").sortWithinPartitions("block").mapInArrow(pair, PAIRS)
    large = written(met.filter(F.col("members") > BLOCK).select(columns).unionByName(rows.join(hot, "label", "left_semi").select(columns)), "large")
    scratch.append(large)
    if not large.isEmpty():
        blocks = dealt(large).repartition("block").sortWithinPartitions("block")
        found = found.unionByName(blocks.mapInArrow(pair, PAIRS))
    return enough_shared(found.groupBy("a", "b").agg(F.sum("shared").alias("shared")), nodes)


PAIRS = "a long, b long, shared long"


def enough_shared(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that share as many rare labels as a similarity of 0.8 needs, and whose parities differ in no more bits than it allows."""
    of = lambda side: nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), *(F.col(p).alias(f"{p}_{side}") for p in PARITIES))
    bits = sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in PARITIES[1:]), F.bit_count(F.col(f"{PARITIES[0]}_a").bitwiseXOR(F.col(f"{PARITIES[0]}_b"))))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.filter(F.col("shared") >= least_shared(F.least("n_a", "n_b"))).filter(9 * bits <= F.col("n_a") + F.col("n_b")).select("a", "b")


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose texts (node, text) are as similar as ``least`` by banded alignment."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.add(pc.binary_length(whole.column("ta")), pc.binary_length(whole.column("tb"))).to_pylist()
            for i, j in slices(sizes, 2 * HASHED_BYTES):
                batch = whole.slice(i, j - i)
                a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
                ids, where = np.unique(np.concatenate([a, b]), return_index=True)
                texts = [batch.column("ta" if w < len(a) else "tb")[int(w % len(a))].as_py() for w in where]
                hashes, n_words = word_hashes(texts)
                labels, n = shingle_labels(hashes, n_words)
                stop = np.cumsum(n)
                of = {i: labels[e - k : e] for i, e, k in zip(ids.tolist(), stop.tolist(), n.tolist(), strict=True)}
                good = [aligned_similarity(of[x], of[y], least) >= least - 1e-12 for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                keep = pa.array(good, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(align, "a long, b long")


#: Bytes of text that the pairs of one part carry through a shuffle, if the texts have no more themselves; and parts at most.
CARRIED, MOST_PARTS = 1 << 28, 64


def verified_parts(pairs: DataFrame, texts: DataFrame) -> list[DataFrame]:
    """Written tables of the ``verified`` pairs. A text goes with each pair that it is in, and families of near copies have far more pairs
    than texts: so pairs are tested in parts that carry about as much as all ``texts`` hold, and the shuffle files of one end before the next."""
    bytes_of = texts.select(F.col("node").alias("a"), F.octet_length("text").cast("long").alias("bytes"))
    held = bytes_of.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    carried = pairs.join(bytes_of, "a").agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    parts = min(MOST_PARTS, 1 + carried // max(CARRIED, held))
    return [written(verified(pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == k), texts), "links") for k in range(parts)]


#: Rounds of proposals before the exact pass. Any number gives the same classes; after one round the exact pass
#: tests what is left for less than a second round costs.
ROUNDS = 1


def near_duplicate_classes(docs: DataFrame, max_rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, class_id (the lowest doc_id of its class) and representative.

    Texts of the same lower-cased words are copies; only one of each meets others. Order MinHash
    sketches make buckets; in each, texts propose the partners whose lanes agree most, blocks of a large bucket
    apart. Proposed pairs are verified by banded alignment of their occurrence-labelled five-word
    shingles and linked at a similarity of 0.8 or more; classes are the connected components of
    links. Further rounds, if any, look at buckets that hold several classes: each text proposes its next partners of
    other classes, until a round links nothing or ``max_rounds`` have passed. This finds most links
    cheaply. All pairs of different classes that are left are then met by their rare labels, by which no
    pair of a similarity of 0.8 is missed, and tested too: classes are exact.

    Rows go by their texts: different texts that share a doc_id, or have none, are documents of their own. Of each
    class the row of the lowest doc_id (of equal ones that of the lowest hash, rows without doc_id last) is
    the representative; rows of the same doc_id and text are both one. A class without any doc_id has a null
    class_id. Null, empty and blank texts have no words and are classes of their own. Very long texts are hashed
    whole, one at a time. An empty table gives no rows; columns other than doc_id and text are left alone.
    """
    return classified(docs, max_rounds).select("doc_id", "class_id", "representative")


def classified(docs: DataFrame, max_rounds: int = ROUNDS) -> DataFrame:
    """(k1, k2, doc_id, class_id, representative, worded) for each row; see ``near_duplicate_classes``."""
    docs = keyed(docs)
    common, counts_of = common_labels(docs)
    made = written(features(docs, common, counts_of), "made")
    all_rows = written(made.select("k1", "k2", "doc_id", "h1", "h2", "n_shingles"), "features")
    worded = all_rows.filter("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2")).alias("rep")
    contents = written(worded.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("count"), first).withColumn("node", F.monotonically_increasing_id()), "contents")
    holders = contents.select("node", F.col("rep.k1").alias("k1"), F.col("rep.k2").alias("k2"))
    nodes = made.filter("n_shingles > 0").join(holders, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    keys = nodes.select("node", F.col("n_shingles").alias("n"), F.posexplode("keys").alias("sketch", "key"))
    counts = keys.groupBy("sketch", "key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    # Lanes are as large as five keys: only those that meet others get them.
    members = written(keys.join(counts, ["sketch", "key"]).join(nodes.select("node", "lanes"), "node"), "members")

    def texts_of(chosen: DataFrame) -> DataFrame:
        """(node, text) of the ``chosen`` holders."""
        return docs.join(chosen, ["k1", "k2"]).dropDuplicates(["k1", "k2"]).select("node", "text")

    # Whole texts are shuffled once, and only those that meet others are kept for all rounds.
    meeting = members.select("node").distinct()
    few_texts = written(texts_of(holders.join(meeting, "node", "left_semi")), "texts")

    def blocks(rows: DataFrame, number: int) -> DataFrame:
        part = F.pmod(F.xxhash64("node", "sketch", F.lit(number)), F.ceil(F.col("members") / BLOCK).cast("long"))
        return rows.withColumn("block", F.xxhash64("sketch", "key", part))

    links, classes, tested, scratch = None, None, docs.sparkSession.createDataFrame([], "a long, b long"), []
    for number in range(max_rounds):
        if classes is None:
            rows = members.withColumn("group", F.col("node")).withColumn("tested", F.lit(None).cast("array<long>"))
        else:
            grouped = members.join(classes, "node", "left").withColumn("group", F.coalesce("class", "node")).drop("class")
            open_ = grouped.groupBy("sketch", "key").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select("sketch", "key")
            both = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
            rows = grouped.join(open_, ["sketch", "key"]).join(both.groupBy(F.col("a").alias("node")).agg(F.collect_list("b").alias("tested")), "node", "left")
        pairs = written(proposals(blocks(rows, number), number), "pairs")
        scratch.append(pairs)
        tested = tested.unionByName(pairs)
        found = verified_parts(pairs, few_texts)
        scratch += found
        new = reduce(DataFrame.unionByName, found)
        links = new if links is None else links.unionByName(new)
        if new.isEmpty():
            break
        classes = components(links)
        scratch.append(classes)

    # All pairs of different classes that may still link: every one is tested, so that no link crosses classes.
    rest = nodes.select("node", F.col("n_shingles").alias("n"), "prefix", *PARITIES)
    rest = rest.withColumn("group", F.col("node")) if classes is None else rest.join(classes, "node", "left").withColumn("group", F.coalesce("class", "node"))
    rest, passing = written(rest, "rest"), []
    for done in (made, members):
        drop_table(done)
    pairs = written(rest_of_pairs(rest, passing).join(tested, ["a", "b"], "left_anti"), "pairs")
    for done in (rest, *passing):
        drop_table(done)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    more = written(holders.join(ids.join(few_texts.select("node"), "node", "left_anti"), "node", "left_semi"), "more")
    texts = few_texts
    if n_more := more.count():
        # Few texts are picked out of the scan; more are worth a shuffle of all.
        texts = written(texts_of(F.broadcast(more) if n_more <= BROADCAST_ROWS else more), "texts")
        scratch.append(texts)
        texts = few_texts.unionByName(texts)
    found = verified_parts(pairs, texts)
    scratch += found
    new = reduce(DataFrame.unionByName, found)
    if not new.isEmpty():
        classes = components(new if links is None else links.unionByName(new))
        scratch.append(classes)
    out = membership(all_rows, contents, classes)
    for done in (*scratch, contents, few_texts, more, pairs):
        drop_table(done)
    return out


def membership(all_rows: DataFrame, contents: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Each row's class: contents get theirs first, one row each; rows then meet their contents, frequent ones apart."""
    named = contents.withColumn("class", F.col("node"))
    if classes is not None:
        named = contents.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
        lowest = named.groupBy("class").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        named = spread_join(named, lowest, ["class"], "n", "left").withColumn("rep", F.coalesce("low", "rep"))
    named = written(named.select("h1", "h2", "count", F.col("rep.doc_id").alias("class_id"), F.col("rep.k1").alias("r1"), F.col("rep.k2").alias("r2")), "named")
    rows = all_rows.select("k1", "k2", "doc_id", "h1", "h2", (F.col("n_shingles") > 0).alias("worded"))
    met = spread_join(rows.filter("worded"), named, ["h1", "h2"], "count")
    out = met.select("k1", "k2", "doc_id", "class_id", F.expr("k1 = r1 AND k2 = r2").alias("representative"), "worded")
    return out.unionByName(rows.filter("NOT worded").select("k1", "k2", "doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("representative"), "worded"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that represent their classes, with all columns.

    Of rows of the same doc_id and text one stays, with its other columns; different texts of one doc_id, and rows
    without a doc_id, are judged by their own text. Rows without words all stay.
    """
    a, b = free_name(docs.columns, "_k1"), free_name(docs.columns, "_k2")
    own = docs.select("*", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias(a), F.xxhash64(F.lit(7), F.col("text").cast("string"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).alias(b))
    kept = classified(docs).filter("representative AND worded").select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct()
    wordless = ~F.coalesce(F.col("text").cast("string").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    stay = own.join(kept, [a, b], "left_semi").dropDuplicates([a, b])
    return stay.unionByName(own.filter(wordless)).select(*(F.col(f"`{c}`") for c in docs.columns))
