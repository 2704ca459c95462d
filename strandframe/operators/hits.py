"""Pairwise hits to weighted edges: pruning, coverage, identity and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import covered_length


def normalize_coordinates(df: DataFrame, *axes: tuple[str, str]) -> DataFrame:
    for s, e in axes:
        df = df.withColumns({s: F.least(s, e), e: F.greatest(s, e)})
    return df


def drop_self_hits(df: DataFrame, query: str = "query_id", target: str = "target_id") -> DataFrame:
    return df.where(F.col(query).isNotNull() & F.col(target).isNotNull() & (F.col(query) != F.col(target)))


MIN_EVALUE = 1e-3


def prune_hsps(df: DataFrame, query: str, target: str, qlen: str, order: list[str], most: float = 1.10, min_length: int = 0, min_evalue: float = MIN_EVALUE) -> DataFrame:
    """Hits whose span on the query (qstart, qend) and e-value reach the limits, and of these
    the hits of a pair until their spans add up to the query, in the given order."""
    length = "_span"
    df = df.withColumn(length, F.col("qend") - F.col("qstart") + 1).where((F.col(length) >= min_length) & (F.col("evalue") <= min_evalue))
    w = Window.partitionBy(query, target).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum(length).over(w) - F.col(length)
    size = F.first(qlen).over(w)
    return df.withColumns({"_before": before, "_size": size}).where((F.col("_before") < F.col("_size")) & (F.col(length) + F.col("_before") < most * F.col("_size"))).drop("_before", "_size", length)


def pair_identity(df: DataFrame, query: str, target: str, pident: str, length: str) -> DataFrame:
    """Length-weighted identity (two digits) and number of alignments of each pair."""
    return df.groupBy(query, target).agg(F.round(F.try_divide(F.sum(F.col(pident) * F.col(length)), F.sum(length)), 2).alias("identity"), F.count(F.lit(1)).alias("num_alignments"))


def pair_coverage(df: DataFrame, query: str, target: str, axes: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Covered share in percent of each axis (start, end, total length), two digits.

    Both axes go through one window as rows of one table, then turn into columns.
    """
    parts = [df.select(query, target, F.lit(a).alias("axis"), F.col(s).cast("long").alias("s"), F.col(e).cast("long").alias("e"), F.col(n).cast("double").alias("n")) for a, (s, e, n) in axes.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    covered = covered_length(rows, [query, target, "axis", "n"], "s", "e")
    share = F.round(F.try_divide(F.col("covered") * 100.0, F.col("n")), 2)
    return covered.groupBy(query, target).agg(*[F.max(F.when(F.col("axis") == a, share)).alias(f"{a}_coverage") for a in axes])


def hsps_to_edges(df: DataFrame, order: list[str], prune: bool = True, min_identity: float = 0.0, query: str = "query_id", target: str = "target_id", min_length: int = 0, min_evalue: float = MIN_EVALUE) -> DataFrame:
    """Edge table of a hit table with 14 columns; pairs below ``min_identity`` skip the coverage work."""
    flat = normalize_coordinates(drop_self_hits(df, query, target), ("qstart", "qend"), ("sstart", "send"))
    kept = prune_hsps(flat, query, target, "qlen", order, min_length=min_length, min_evalue=min_evalue) if prune else flat.where((F.col("qend") - F.col("qstart") + 1 >= min_length) & (F.col("evalue") <= min_evalue))
    stats = pair_identity(kept, query, target, "pident", "length")
    if min_identity > 0:
        stats = stats.where(F.col("identity") >= min_identity)
        kept = kept.join(stats.select(query, target), [query, target], "left_semi")
    cover = pair_coverage(kept, query, target, {"query": ("qstart", "qend", "qlen"), "target": ("sstart", "send", "slen")})
    return stats.join(cover, [query, target], "left").select(query, target, "identity", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("query_coverage", "target_coverage")], "num_alignments")


def with_global_ani(edges: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """global_ani_query, global_ani_target and tani; the last weighted by whole lengths (seq_id, length) where given.

    Percentages have two digits, so all of it is computed in whole hundredths; halves are rounded up.
    """
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    nearest = lambda top, bottom: F.floor((2 * top + bottom) / (2 * bottom)).cast("long")
    whole = {f"global_ani_{s}": F.floor((cents("identity") * cents(f"{s}_coverage") + 5000) / 10000) / 100.0 for s in ("query", "target")}
    out = edges.withColumns(whole)
    if lengths is None:
        return out.withColumn("tani", nearest(cents("global_ani_query") + cents("global_ani_target"), F.lit(2)) / 100.0)
    for s in ("query", "target"):
        out = out.join(lengths.select(F.col("seq_id").alias(f"{s}_id"), F.col("length").alias(f"_{s}")), f"{s}_id", "left").fillna(0, [f"_{s}"])
    total = F.col("_query") + F.col("_target")
    tani = F.when(total == 0, F.lit(0.0)).otherwise(nearest(cents("global_ani_query") * F.col("_query") + cents("global_ani_target") * F.col("_target"), total) / 100.0)
    return out.withColumn("tani", tani).drop("_query", "_target")


SIMILARITY = {"identity": "identity", "ani": "identity", "tani": "tani", "global_ani_query": "global_ani_query", "global_ani_target": "global_ani_target", "query_coverage": "query_coverage", "target_coverage": "target_coverage"}


def filter_edges(edges: DataFrame, metric: str = "identity", least: float = 95.0, min_qcov: float = 0.0, min_tcov: float = 85.0, min_af: float = 0.0) -> DataFrame:
    """Edges that reach the thresholds; a coverage limit of 0 is no limit."""
    tests: list[Column] = [F.col(SIMILARITY[metric]) >= least]
    for limit, value in ((min_qcov, F.col("query_coverage")), (min_tcov, F.col("target_coverage")), (min_af, F.least("query_coverage", "target_coverage"))):
        tests += [value >= limit] if limit > 0 else []
    for t in tests:
        edges = edges.where(t)
    return edges


def reverse_coverage(edges: DataFrame) -> DataFrame:
    """target_coverage from the edge of the other direction, else the own one."""
    other = edges.select(F.col("target_id").alias("query_id"), F.col("query_id").alias("target_id"), F.col("query_coverage").alias("_reverse"))
    return edges.join(other, ["query_id", "target_id"], "left").withColumn("target_coverage", F.coalesce("_reverse", "target_coverage")).drop("_reverse")


def dedupe_ani(edges: DataFrame) -> DataFrame:
    """One row for each ordered pair: mean identity, largest coverage, number of rows."""
    return edges.groupBy("query_id", "target_id").agg(F.avg("identity").alias("identity"), F.max("query_coverage").alias("query_coverage"), F.max("target_coverage").alias("target_coverage"), F.count(F.lit(1)).alias("num_alignments"))


def prefilter_pairs(edges: DataFrame, pairs: DataFrame, a: str = "seq_a", b: str = "seq_b") -> DataFrame:
    """Edges whose pair, in either direction, is among ``pairs``."""
    both = pairs.select(F.col(a).alias("query_id"), F.col(b).alias("target_id")).union(pairs.select(b, a)).distinct()
    return edges.join(both, ["query_id", "target_id"], "left_semi")


def fragment_length(df: DataFrame, length: str, share: float = 0.25) -> DataFrame:
    """A fragment length from the lower quartile of sequence lengths."""
    return df.agg(F.expr(f"cast(percentile_disc({share}) within group (order by {length}) as bigint)").alias("fragment_length"))
