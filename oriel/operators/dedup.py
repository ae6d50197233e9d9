"""Exact and near duplicates: groups by content, and Hamming joins by bands that are exact."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oriel.functions.hashing import hamming
from oriel.plans.tables import written


def exact_groups(rows: DataFrame, key: str, member: str) -> DataFrame:
    """Content that occurs more than once: key, copies, first member."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), F.min(member).alias("first_member")).filter("copies > 1")


def band_keys(column: str, threshold: int, agree: int) -> F.Column:
    """Keys such that two 64-bit hashes within ``threshold`` share one: the bits are cut into
    ``threshold + agree`` bands, of which any two such hashes agree in ``agree``; each choice of
    ``agree`` bands gives a key. More bands to agree make keys more selective, and more of them."""
    n = threshold + agree
    cuts = [round(64 * k / n) for k in range(n + 1)]
    band = [F.shiftrightunsigned(F.col(column), cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1).cast("long")) for k in range(n)]
    return F.array(*(F.xxhash64(F.lit(i), *(band[k] for k in c)) for i, c in enumerate(combinations(range(n), agree))))


#: Distinct hashes that share one band key, beyond which bands are made more selective, and bands that may have to agree.
BAND_ROWS, MOST_AGREE = 512, 5


def chosen_agree(hashes: DataFrame, threshold: int) -> int:
    """How many bands must agree so that no key holds over ``BAND_ROWS`` distinct hashes, as far as ``MOST_AGREE`` allows: the
    ``agree`` to give for tables of so many hashes (over some ten millions) that 21 bits leave too many candidates. More agreeing bands
    make up to 252 keys of 32 bits at a threshold of 5."""
    for agree in range(2, MOST_AGREE):
        keys = hashes.select(F.explode(band_keys("hash", threshold, agree)).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("n"))
        if (keys.agg(F.max("n").alias("n")).first()["n"] or 0) <= BAND_ROWS:
            return agree
    return MOST_AGREE


#: Keys that one half of a hash makes at most.
HALF_KEYS = 15


def half_keys(column: str, threshold: int) -> F.Column:
    """Keys such that two 64-bit hashes within ``threshold`` share one. Of their two halves of 32 bits one differs in at most
    ``threshold // 2`` bits, so only that half need agree in all of its bands but so many: at a threshold of 5 each half has 6 bands
    of which 4 agree, which makes 30 keys of 21 bits."""
    few = threshold // 2
    agree = max([a for a in range(1, 5) if comb(few + a, a) <= HALF_KEYS], default=1)
    n = few + agree
    keys = []
    for half in (0, 32):
        cuts = [half + round(32 * k / n) for k in range(n + 1)]
        band = [F.shiftrightunsigned(F.col(column), cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1).cast("long")) for k in range(n)]
        keys += [F.xxhash64(F.lit(half * 1000 + i), *(band[k] for k in c)) for i, c in enumerate(combinations(range(n), agree))]
    return F.array(*keys)


def keyed(hashes: DataFrame, threshold: int, agree: int | None) -> DataFrame:
    """``hashes`` once for each of their keys, as ``band``. Spark takes this for no larger than ``hashes`` and would broadcast it, so
    joins of it are told to shuffle; an explicit broadcast still holds."""
    return hashes.withColumn("band", F.explode(band_keys("hash", threshold, agree) if agree else half_keys("hash", threshold))).hint("merge")


def near_hashes(left: DataFrame, right: DataFrame, threshold: int, agree: int | None = None) -> DataFrame:
    """Distinct pairs (a, b) of 64-bit hashes of ``left`` and ``right`` (column ``hash``) within ``threshold`` bits.

    Both sides are reduced to distinct hashes first, so copies never multiply. Exact: keys only choose candidates, and every
    pair within the threshold is one. The result holds all such pairs: where only the earliest or any near hash is
    asked for, ``earliest_near`` and ``near_any`` make none of them. Keys are half keys, or with ``agree`` those of so many
    agreeing bands (``chosen_agree``).
    """
    a = keyed(left.select("hash").distinct(), threshold, agree).withColumnRenamed("hash", "a")
    b = keyed(right.select("hash").distinct(), threshold, agree).withColumnRenamed("hash", "b")
    return a.join(b, "band").filter(hamming("a", "b") <= threshold).select("a", "b").distinct()


#: The first range of an index holds so many hashes, each next one so many times as many.
FIRST_RANGE, GROWTH = 64, 16
#: Places of the index that the driver looks up at most; later cuts come from quantiles.
HEAD = FIRST_RANGE * GROWTH
#: Up to so many hashes one cut is enough, as each range costs a written table.
ONE_CUT = HEAD * GROWTH
#: About so many values, picked by hash and at most twice as many, tell the later cuts.
CUT_VALUES = 20_000


def index_cuts(hashes: DataFrame, order: str, first: int) -> list:
    """Values of ``order`` that end rising ranges of ``first`` hashes, ``GROWTH`` times as many, and so on: exact as far as ``HEAD``, about
    right beyond it. ``order`` may be of any type that can be sorted; cuts only divide the work, any are exact."""
    n, sizes = hashes.count(), []
    while first < n:
        sizes.append(first)
        first *= GROWTH
    head = [r[0] for r in hashes.select(order).orderBy(order).limit(HEAD).collect()] if sizes and sizes[0] <= HEAD else []
    shares = [k / n for k in sizes if k > HEAD]
    if not shares:
        return sorted({head[k - 1] for k in sizes if k <= HEAD})
    some = hashes.select(order).filter(F.pmod(F.xxhash64(order), F.lit(max(1, n // CUT_VALUES))) == 0)
    values = some.agg(F.sort_array(F.collect_list(order)).alias("v")).select(F.transform(F.array(*map(F.lit, shares)), lambda s: F.get("v", F.floor(s * F.size("v")).cast("int"))).alias("v"))
    return sorted({*(head[k - 1] for k in sizes if k <= HEAD), *(v for v in values.first()["v"] if v is not None)})


def earliest_near(x: DataFrame, y: DataFrame, threshold: int, agree: int | None = None, where: str = "true") -> DataFrame:
    """(columns of ``x``, m): for each row of ``x`` (hash, ..., all distinct) the least ``order`` of a row of ``y`` (hash, order, ...)
    within ``threshold`` bits and ``where``, and the distance; rows without one are left out.

    ``y`` is looked through in rising ranges of its order, and a row that has found a match looks no further: what follows
    can't be earlier. So in a large family of near hashes most rows meet only its first members, and no pairs are listed. The
    first ranges hold at most ``HEAD`` hashes and are broadcast.
    """
    names, few = x.columns, y.count() <= ONE_CUT
    cuts = index_cuts(y, "order", 4 * FIRST_RANGE)[:1] if few else index_cuts(y, "order", FIRST_RANGE)
    left, found = x, []
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = y if low is None else y.filter(F.col("order") > F.lit(low))
        part = keyed(part if high is None else part.filter(F.col("order") <= F.lit(high)), threshold, agree).withColumnRenamed("hash", "b")
        part = F.broadcast(part) if high is not None and k < 2 else part
        near = keyed(left, threshold, agree).join(part, "band").filter(hamming("hash", "b") <= threshold).filter(where)
        hit = near.groupBy(*names).agg(F.min(F.struct("order", hamming("hash", "b").alias("distance"))).alias("m"))
        found.append(hit if high is None else written(hit, "earliest"))
        left = left.join(found[-1], names, "left_anti")
    return reduce(DataFrame.unionByName, found)


def first_near(rows: DataFrame, threshold: int, agree: int | None = None) -> DataFrame:
    """For each row (idx, hash, ...) its earliest earlier row within ``threshold`` bits: adds match_idx and distance; null if none.

    Only the first row of each hash can be anyone's earliest match.
    """
    firsts = written(rows.groupBy("hash").agg(F.min("idx").alias("order")), "firsts")
    reach = earliest_near(firsts.select("hash"), firsts, threshold, agree)
    out = rows.join(reach, "hash", "left")
    earlier = F.col("m.order") < F.col("idx")
    return out.withColumn("match_idx", F.when(earlier, F.col("m.order"))).withColumn("distance", F.when(earlier, F.col("m.distance"))).drop("m")


def near_any(rows: DataFrame, reference: DataFrame, threshold: int, agree: int | None = None) -> DataFrame:
    """Rows within ``threshold`` bits of any hash of ``reference``; a row's key stops at its first near one."""
    a = keyed(rows.select("hash").distinct(), threshold, agree)
    b = keyed(reference.select(F.col("hash")).distinct(), threshold, agree).withColumnsRenamed({"hash": "b", "band": "_band"})
    close = a.join(b, (F.col("band") == F.col("_band")) & (hamming("hash", "b") <= threshold), "left_semi").select("hash").distinct()
    return rows.join(close, "hash", "left_semi")


def split_leaks(rows: DataFrame, threshold: int, mode: str = "first_match", agree: int | None = None) -> DataFrame:
    """Rows (idx, hash, split) near a row of another split.

    ``first_match`` looks only at each row's earliest earlier match; ``all_pairs`` at all earlier rows, and
    gives the earliest one of another split. All pairs need only the first row of each hash and split.
    """
    if mode == "first_match":
        m = first_near(rows, threshold, agree).filter("match_idx IS NOT NULL")
        other = rows.select(F.col("idx").alias("match_idx"), F.col("split").alias("match_split"))
        return m.join(other, "match_idx").filter("split <> match_split").select("idx", "match_idx", "split", "match_split", "distance")
    if mode != "all_pairs":
        raise ValueError("mode must be first_match or all_pairs")
    firsts = written(rows.groupBy("hash", "split").agg(F.min("idx").alias("order")), "firsts")
    others = firsts.withColumnRenamed("split", "match_split")
    best = earliest_near(firsts.select("hash", "split"), others, threshold, agree, "split <> match_split")
    near = rows.join(best, ["hash", "split"]).filter("m.order < idx")
    splits = rows.select(F.col("idx").alias("match_idx"), F.col("split").alias("match_split"))
    return near.withColumn("match_idx", F.col("m.order")).join(splits, "match_idx").select("idx", "match_idx", "split", "match_split", "m.distance")


#: Pairs that one task folds in order of rank, at most.
FOLD_PAIRS = 1 << 20


def folded(pairs: DataFrame) -> DataFrame:
    """(a): the hashes that greedy retention drops, of at most ``FOLD_PAIRS`` pairs (a, b, ra): b comes before a. One task walks
    them in order of rank."""

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        gone: set[int] = set()
        rows = rows.sort_values("ra")
        for a, b in zip(rows["a"].tolist(), rows["b"].tolist(), strict=True):
            if b not in gone:
                gone.add(a)
        return pd.DataFrame({"a": pd.Series(sorted(gone), dtype="int64")})

    return pairs.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(walk, "a long")


def dropped_by(pairs: DataFrame) -> DataFrame:
    """(a): the hashes dropped in order of rank, for pairs (a, b, ra) of near hashes of which b comes before a.

    As soon as few pairs are open, one task folds them, so a long chain takes no rounds. While there are more, a round keeps
    hashes all of whose earlier near ones are dropped, and drops those near a kept one.
    """
    open_, lost = written(pairs, "open"), []
    while open_.count() > FOLD_PAIRS:
        waiting = open_.select(F.col("a").alias("b")).distinct()
        hit = written(open_.join(waiting, "b", "left_anti").select("a").distinct(), "lost")  # near a hash that nothing earlier can drop
        lost.append(hit)
        open_ = written(open_.join(hit, "a", "left_anti").join(hit.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b", "ra"), "open")
    return reduce(DataFrame.unionByName, [*lost, folded(open_)])


def greedy_keep(rows: DataFrame, threshold: int, agree: int | None = None, limit: int | None = None) -> DataFrame:
    """Greedy retention in order of ``rank``: a row is kept unless it is within ``threshold`` bits of a kept
    earlier one. Adds ``kept``. With ``limit``, rows after the ``limit``-th kept one aren't looked at: ``kept`` is null.

    Equal hashes stand for their first row. Ranks are gone through in rising ranges: what is near a hash kept in an earlier range
    goes at once, and only what is left of a range is compared with itself. So a large family of near hashes is thinned out by its
    first members, and its pairs are never listed.
    """
    firsts = written(rows.groupBy("hash").agg(F.min("rank").alias("order")), "firsts")
    cuts, kept, dropped = index_cuts(firsts, "order", HEAD), None, []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = firsts if low is None else firsts.filter(F.col("order") > F.lit(low))
        part = part if high is None else part.filter(F.col("order") <= F.lit(high))
        if kept is not None:
            near = written(near_any(part.select("hash"), kept, threshold, agree), "near")
            dropped.append(near)
            part = part.join(near, "hash", "left_anti")
        part = written(part, "part")
        pairs = near_hashes(part, part, threshold, agree).filter("a <> b")
        pairs = pairs.join(part.select(F.col("hash").alias("a"), F.col("order").alias("ra")), "a").join(part.select(F.col("hash").alias("b"), F.col("order").alias("rb")), "b").filter("rb < ra").select("a", "b", "ra")
        gone = written(dropped_by(pairs).select(F.col("a").alias("hash")), "gone")
        dropped.append(gone)
        if high is not None:
            now = written(part.join(gone, "hash", "left_anti").select("hash"), "kept")
            kept = now if kept is None else kept.unionByName(now)
    lost = reduce(DataFrame.unionByName, dropped).select(F.col("hash"), F.lit(True).alias("_lost"))
    out = rows.join(firsts, "hash").join(lost, "hash", "left").withColumn("kept", (F.col("rank") == F.col("order")) & F.col("_lost").isNull()).drop("order", "_lost")
    if limit is None:
        return out
    out = written(out, "greedy")
    end = out.filter("kept").orderBy("rank").limit(limit).agg(F.max("rank").alias("_end"), F.count(F.lit(1)).alias("_n"))
    return out.join(F.broadcast(end), how="inner").withColumn("kept", F.when((F.col("_n") < limit) | (F.col("rank") <= F.col("_end")), F.col("kept"))).drop("_end", "_n")


def subset_reasons(public: DataFrame, protected: DataFrame, station: DataFrame, threshold: int, limit: int | None = None) -> DataFrame:
    """Why rows of ``public`` don't come into a subset: adds ``reason``, the first that holds of ``unpaired``, ``invalid_pair``,
    ``protected_exact``, ``station_exact``, ``public_exact``, ``protected_near``, ``station_near`` and ``public_near``, else ``retained``.

    ``public`` has rank (unique), key (content), hash (perceptual), paired and valid (booleans; null fails); ``protected`` and ``station`` have key
    and hash. Rows are judged in order of rank, and the ``public_`` reasons look at retained rows only. With ``limit``, rows after the
    ``limit``-th retained one aren't looked at: their reason is null. A null key equals none, a null hash is near none.

    Which contents are near the two other sets doesn't depend on the order, so only what is left goes through greedy
    retention, by its first row; other rows of a content are exact copies if that one is retained, and share its fate if not.
    """
    flag = lambda d, name: d.select("key").filter("key IS NOT NULL").distinct().withColumn(name, F.lit(True))
    near = lambda d, name: near_any(hashes, d.select("hash").filter("hash IS NOT NULL"), threshold).withColumn(name, F.lit(True))
    x = public.join(flag(protected, "_pe"), "key", "left").join(flag(station, "_se"), "key", "left")
    early = F.when(~F.coalesce("paired", F.lit(False)), "unpaired").when(~F.coalesce("valid", F.lit(False)), "invalid_pair").when(F.col("_pe"), "protected_exact").when(F.col("_se"), "station_exact")
    x = written(x.withColumn("_early", early).drop("_pe", "_se"), "judged")
    hashes = x.filter("_early IS NULL AND hash IS NOT NULL").select("hash").distinct()
    x = x.join(near(protected, "_pn"), "hash", "left").join(near(station, "_sn"), "hash", "left")
    late = F.when(F.col("_pn"), "protected_near").when(F.col("_sn"), "station_near")
    x = written(x.withColumn("_static", F.coalesce("_early", late)).drop("_early", "_pn", "_sn"), "judged")
    open_ = x.filter("_static IS NULL")
    first = open_.filter("key IS NOT NULL").groupBy("key").agg(F.min("rank").alias("_first"))
    heads = open_.join(first, "key", "left").filter("_first IS NULL OR rank = _first").filter("hash IS NOT NULL").select("rank", "hash")
    lost = greedy_keep(heads, threshold).filter("NOT kept").select(F.col("rank").alias("_first"), F.lit(True).alias("_lost"))
    x = x.join(first, "key", "left").withColumn("_first", F.coalesce("_first", "rank")).join(lost, "_first", "left")
    own = F.when(F.col("_lost"), "public_near").when(F.col("rank") > F.col("_first"), "public_exact").otherwise("retained")
    out = x.withColumn("reason", F.coalesce("_static", own)).drop("_static", "_first", "_lost")
    if limit is None:
        return out
    out = written(out, "reasons")
    end = out.filter("reason = 'retained'").orderBy("rank").limit(limit).agg(F.max("rank").alias("_end"), F.count(F.lit(1)).alias("_n"))
    return out.join(F.broadcast(end), how="inner").withColumn("reason", F.when((F.col("_n") < limit) | (F.col("rank") <= F.col("_end")), F.col("reason"))).drop("_end", "_n")
