"""Interval operators: overlap and envelope joins, coverage, and the
consolidation of hit tables.

Every operator works within a group key (the query). Ranks make total orders:
the caller names rank columns as ``-score,+evalue`` and tie-break columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt

BIN = 1 << 10


def _rank_order(rank: str, columns: list[str]) -> list[Column]:
    """Sort columns of ``-a,+b``; ranks that the table lacks are left out."""
    out = []
    for part in rank.split(","):
        name = part.strip().lstrip("+-")
        if name in columns:
            out.append(F.col(name).desc_nulls_last() if part.strip().startswith("-") else F.col(name).asc_nulls_last())
    return out


def with_uid(df: DataFrame, query: str, rank: str, ties: list[str]) -> DataFrame:
    """``uid``: position in the query by rank, then by the tie-break columns, from 1."""
    return df.withColumn("uid", F.row_number().over(Window.partitionBy(query).orderBy(*_rank_order(rank, df.columns), *ties)))


# ---- joins ----------------------------------------------------------------


def overlap_join(a: DataFrame, b: DataFrame, query: str, start: str, end: str, least: int = 1, bins: int = BIN) -> DataFrame:
    """Pairs of half-open intervals of one query that share ``least`` positions or more.

    Both sides carry the columns query, start, end and others under ``a_`` and
    ``b_``. The join is on query and a bin of positions, so a heavy query is
    spread over its bins; a pair counts in the first bin that it shares.
    """
    binned = lambda df, p: df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns]).withColumn(f"{p}_bin", F.explode(F.sequence(F.floor(F.col(f"{p}_{start}") / bins), F.floor((F.greatest(F.col(f"{p}_{end}") - 1, F.col(f"{p}_{start}"))) / bins))))
    x, y = binned(a, "a"), binned(b, "b")
    shared = F.least(f"a_{end}", f"b_{end}") - F.greatest(f"a_{start}", f"b_{start}")
    first_bin = F.floor(F.greatest(F.col(f"a_{start}"), F.col(f"b_{start}")) / bins)
    on = (F.col(f"a_{query}") == F.col(f"b_{query}")) & (F.col("a_bin") == F.col("b_bin")) & (shared >= least) & (F.col("a_bin") == first_bin)
    return x.join(y, on).drop("a_bin", "b_bin")


def overlapping(df: DataFrame, query: str, start: str, end: str, uid: str, least: int = 1) -> DataFrame:
    """uid and the sorted uids of the others that it overlaps."""
    pairs = overlap_join(df.select(query, start, end, uid), df.select(query, start, end, uid), query, start, end, least).where(f"a_{uid} <> b_{uid}")
    return pairs.groupBy(F.col(f"a_{query}").alias(query), F.col(f"a_{uid}").alias(uid)).agg(F.array_sort(F.collect_list(f"b_{uid}")).alias("overlaps"))


def enveloping(df: DataFrame, query: str, start: str, end: str, uid: str) -> DataFrame:
    """uid and the sorted uids of the others that contain it."""
    pairs = overlap_join(df.select(query, start, end, uid), df.select(query, start, end, uid), query, start, end, 1)
    inside = (F.col(f"b_{start}") <= F.col(f"a_{start}")) & (F.col(f"b_{end}") >= F.col(f"a_{end}")) & (F.col(f"a_{uid}") != F.col(f"b_{uid}"))
    return pairs.where(inside).groupBy(F.col(f"a_{query}").alias(query), F.col(f"a_{uid}").alias(uid)).agg(F.array_sort(F.collect_list(f"b_{uid}")).alias("envelopes"))


# ---- coverage -------------------------------------------------------------


def covered_length(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Length of the union of inclusive intervals of each key (``covered``)."""
    before = F.max(end).over(Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(before + 1, F.col(start))) + 1)
    return df.withColumn("_new", fresh).groupBy(*keys).agg(F.sum("_new").alias("covered"))


# ---- consolidation --------------------------------------------------------


def one_per_query(df: DataFrame, query: str, rank: str, ties: list[str]) -> DataFrame:
    return with_uid(df, query, rank, ties).where("uid = 1").drop("uid")


def drop_contained(df: DataFrame, query: str, start: str, end: str, rank: str, ties: list[str]) -> DataFrame:
    """Without intervals nested in another; of equal ones the best rank stays; empty ones are never dropped.

    In order of start, then longer first, then rank, an interval is nested
    exactly if an earlier one ends as late: a running maximum, no self-join.
    """
    ranked = with_uid(df, query, rank, ties)
    before = F.max(F.when(F.col(end) > F.col(start), F.col(end))).over(Window.partitionBy(query).orderBy(F.col(start), F.col(end).desc(), F.col("uid")).rowsBetween(Window.unboundedPreceding, -1))
    return ranked.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") < F.col(end)) | (F.col(end) <= F.col(start))).drop("_before", "uid")


def one_per_range(df: DataFrame, query: str, start: str, end: str, rank: str, ties: list[str], least: int = 1) -> DataFrame:
    """Greedy by rank: a hit stays unless it overlaps a kept one by ``least`` or more.

    The order matters, so a query's hits are folded in one array expression;
    a query's hits must fit a task, which holds for hits on one sequence.
    """
    ranked = with_uid(df, query, rank, ties)
    hits = F.array_sort(F.collect_list(F.struct("uid", F.col(start).alias("s"), F.col(end).alias("e"))))
    clash = lambda kept, x: F.exists(kept, lambda k: (F.least(k["e"], x["e"]) - F.greatest(k["s"], x["s"])) >= least)
    fold = F.aggregate(hits, F.array().cast("array<struct<uid:int,s:bigint,e:bigint>>"), lambda kept, x: F.when(clash(kept, x), kept).otherwise(F.concat(kept, F.array(F.struct(x["uid"].alias("uid"), x["s"].cast("bigint").alias("s"), x["e"].cast("bigint").alias("e"))))))
    kept = ranked.groupBy(query).agg(fold.alias("_kept")).select(query, F.explode(F.transform("_kept", lambda k: k["uid"])).alias("uid"))
    return ranked.join(kept, [query, "uid"], "left_semi").drop("uid")


def merge_overlapping(df: DataFrame, query: str, start: str, end: str, rank: str, ties: list[str], least: int = 1) -> DataFrame:
    """Components of intervals (inclusive) that overlap by ``least``: least start, largest end, the best rank's other columns.

    Intervals shorter than ``least`` cannot overlap by it and stay alone; for
    the rest, a running maximum of ends marks where a component begins.
    """
    ranked = with_uid(df, query, rank, ties)
    short = F.col(end) - F.col(start) + 1 < least
    w = Window.partitionBy(query, "_short").orderBy(start, end, "uid")
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("_short") | before.isNull() | (F.least(before, F.col(end)) - F.col(start) + 1 < least)
    island = ranked.withColumn("_short", short).withColumn("_opens", opens.cast("int")).withColumn("_island", F.sum("_opens").over(w))
    others = [c for c in df.columns if c not in (query, start, end)]
    merged = island.groupBy(query, "_short", "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.min_by(F.struct(*others), "uid").alias("_best"))
    return merged.select(query, start, end, *[F.col(f"_best.{c}").alias(c) for c in others]).select(*df.columns)


def split_ranges(df: DataFrame, query: str, start: str, end: str, rank: str, ties: list[str]) -> DataFrame:
    """Half-open intervals minus the union of those of better rank; what is left may be several pieces.

    Positions of a query are cut at all ends; a piece belongs to the best hit
    that covers it, and neighbouring pieces of one hit are joined again.
    """
    ranked = with_uid(df, query, rank, ties)
    cuts = ranked.select(query, F.col(start).alias("_p")).union(ranked.select(query, F.col(end))).distinct()
    pieces = cuts.withColumn("_q", F.lead("_p").over(Window.partitionBy(query).orderBy("_p"))).where("_q is not null")
    own = overlap_join(pieces, ranked.select(query, F.col(start).alias("_p"), F.col(end).alias("_q"), "uid"), query, "_p", "_q", 1)
    best = own.groupBy(F.col(f"a_{query}").alias(query), F.col("a__p").alias("_p"), F.col("a__q").alias("_q")).agg(F.min("b_uid").alias("uid"))
    w = Window.partitionBy(query, "uid").orderBy("_p")
    runs = best.withColumn("_new", (F.lag("_q").over(w) != F.col("_p")).cast("int")).withColumn("_run", F.sum(F.coalesce("_new", F.lit(1))).over(w))
    joined = runs.groupBy(query, "uid", "_run").agg(F.min("_p").alias("_s"), F.max("_q").alias("_e"))
    return joined.join(ranked, [query, "uid"]).select(*[F.col("_s").alias(c) if c == start else F.col("_e").alias(c) if c == end else c for c in df.columns])


#: Hits that one task gets on average, however many there are.
TASK_HITS = 1 << 19


def _by_query(df: DataFrame, query: str) -> DataFrame:
    """Dealt by query to as many tasks as its rows need, so a task's memory doesn't follow the input."""
    return df.repartition(max(1, -(-df.count() // TASK_HITS)), query)


def polyproteins(df: DataFrame, query: str, target: str, start: str, end: str, qlen: str, bin_size: int = 50) -> DataFrame:
    """Queries with 10 hits or more, a length of 200 or more, and two bins with three distinct profiles."""
    return _polyproteins(_by_query(df, query), query, target, start, end, qlen, bin_size)


def _polyproteins(df: DataFrame, query: str, target: str, start: str, end: str, qlen: str, bin_size: int = 50) -> DataFrame:
    whole = df.groupBy(query).agg(F.count(F.lit(1)).alias("n"), F.max(qlen).alias("qlen")).where("n >= 10 and qlen >= 200")
    last = F.floor(F.col("_qlen") / bin_size)
    middle = F.floor((F.col(start) + F.col(end)) / 2)
    binned = df.drop("_qlen").join(dealt(whole.select(query, F.col("qlen").alias("_qlen"))), query).withColumn("_bin", F.least(F.floor(middle / bin_size), last))
    rich = binned.groupBy(query, "_bin").agg(F.count_distinct(target).alias("k")).where("k >= 3")
    return rich.groupBy(query).agg(F.count(F.lit(1)).alias("bins")).where("bins >= 2").select(query)


def overlap_limit(length: Column, polyprotein: Column) -> Column:
    """Allowed overlap by alignment length, stricter on polyproteins."""
    ladder = lambda a, b, c, d: F.when(length < 100, a).when(length < 200, b).when(length < 400, c).otherwise(d)
    return F.when(polyprotein, ladder(5, 8, 12, 15)).otherwise(ladder(10, 15, 25, 40))


def adaptive_limit(df: DataFrame, query: str, target: str, start: str, end: str, qlen: str, per_hit: bool = False) -> DataFrame:
    """The least limit over all hits as one row; or each hit's own."""
    df = _by_query(df, query)
    poly = _polyproteins(df, query, target, start, end, qlen).withColumn("_poly", F.lit(True))
    limits = df.join(dealt(poly), query, "left").withColumn("overlap_limit", overlap_limit(F.col(end) - F.col(start), F.coalesce("_poly", F.lit(False)))).drop("_poly")
    return limits if per_hit else limits.agg(F.min("overlap_limit").alias("overlap_limit"))


MODES = ("one_per_query", "split", "drop_contained", "one_per_range", "merge", "simple")


def consolidate(df: DataFrame, mode: str, query: str, start: str, end: str, rank: str = "-score", ties: list[str] | None = None, least: int = 1, adaptive: dict | None = None) -> DataFrame:
    """Resolves the overlaps of a hit table; ``simple`` drops contained hits, then keeps one per range.

    Whole-row repeats and the order of coordinates are settled first; with
    ``adaptive`` (target and qlen columns) the limit comes from the hits.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    flat = df.distinct().withColumns({start: F.least(start, end), end: F.greatest(start, end)})
    ties = ties or [c for c in df.columns if c != query]
    if adaptive:
        least = adaptive_limit(flat, query, adaptive["target"], start, end, adaptive["qlen"]).first()[0] or least
    if mode == "one_per_query":
        return one_per_query(flat, query, rank, ties)
    if mode == "split":
        return split_ranges(flat, query, start, end, rank, ties)
    if mode == "merge":
        return merge_overlapping(flat, query, start, end, rank, ties, least)
    kept = drop_contained(flat, query, start, end, rank, ties) if mode in ("drop_contained", "simple") else flat
    return one_per_range(kept, query, start, end, rank, ties, least) if mode in ("one_per_range", "simple") else kept
