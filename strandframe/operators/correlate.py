"""Correlation and co-occurrence of rows of an abundance matrix, in long form.

matrix: contig_id, sample, value (no nulls). Contigs are dealt into blocks; a
pair of blocks meets once, so the work of a sample is spread over as many tasks
as there are pairs of blocks, and a pair of contigs is summed inside one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .tables import number_rows


def to_long(df: DataFrame, id_: str, samples: list[str]) -> DataFrame:
    """Wide table to (contig_id, sample, value); values that are null or no numbers are 0."""
    cast = df.select(F.col(id_).alias("contig_id"), *[F.coalesce(F.expr(f"try_cast(`{s}` as double)"), F.lit(0.0)).alias(s) for s in samples])
    return cast.unpivot("contig_id", samples, "sample", "value")


def table_type(matrix: DataFrame) -> DataFrame:
    """presence-absence if all values are 0 or 1, else abundance."""
    binary = F.coalesce(F.bool_and(F.col("value").isin(0.0, 1.0)), F.lit(True))
    return matrix.agg(F.when(binary, "presence-absence").otherwise("abundance").alias("table_type"))


def prevalent(matrix: DataFrame, threshold: float = 0.0, least: float = 0.1) -> DataFrame:
    """Rows of contigs that are present (value > threshold) in a share ``least`` of samples."""
    share = matrix.groupBy("contig_id").agg((F.count_if(F.col("value") > threshold) / F.count(F.lit(1))).alias("share")).where(F.col("share") >= least)
    return matrix.join(share.select("contig_id"), "contig_id", "left_semi")


def ranked(matrix: DataFrame) -> DataFrame:
    """Values replaced by their ranks within the contig, ties averaged."""
    w = Window.partitionBy("contig_id").orderBy("value")
    ties = F.count(F.lit(1)).over(Window.partitionBy("contig_id", "value"))
    return matrix.select("contig_id", "sample", (F.rank().over(w) + (ties - 1) / 2.0).alias("value"))


#: Blocks of contigs: so many rows are sent to each side of a block pair.
BLOCKS = 8


def _blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of a self-join over block pairs: each row goes once to every pair of blocks that its block is in."""
    own = F.pmod(F.xxhash64("contig_id"), F.lit(BLOCKS)).cast("int")
    placed = rows.withColumn("block", own)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda o: F.least("block", o) * BLOCKS + F.greatest("block", o))
    dealt = placed.withColumn("meet", F.explode(pairs))
    return dealt.alias("a"), dealt.alias("b")


def _once() -> Column:
    """The pair of blocks is that of the two rows: rows of one block meet at (block, block) only."""
    return F.col("a.meet") == F.least("a.block", "b.block") * BLOCKS + F.greatest("a.block", "b.block")


def correlation_pairs(matrix: DataFrame, method: str = "pearson", least: float = 0.5) -> DataFrame:
    """contig_1 > contig_2 with correlation >= least; a constant row has no correlation and no pair."""
    m = ranked(matrix) if method == "spearman" else matrix
    shifted = m.join(m.groupBy("contig_id").agg(F.avg("value").alias("mean")), "contig_id").select("contig_id", "sample", (F.col("value") - F.col("mean")).alias("x"))
    norm = shifted.groupBy("contig_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    live = shifted.join(norm.where("norm > 1e-12"), "contig_id").select("contig_id", "sample", (F.col("x") / F.col("norm")).alias("z"))
    a, b = _blocks(live)
    dot = a.join(b, (F.col("a.meet") == F.col("b.meet")) & (F.col("a.sample") == F.col("b.sample")) & (F.col("a.contig_id") > F.col("b.contig_id")) & _once()).groupBy(F.col("a.contig_id").alias("contig_1"), F.col("b.contig_id").alias("contig_2")).agg(F.sum(F.col("a.z") * F.col("b.z")).alias("correlation"))
    return dot.where(F.col("correlation") >= least)


def cooccurrence_pairs(matrix: DataFrame, threshold: float = 0.0, least: int = 1) -> DataFrame:
    """contig_1 > contig_2, shared samples and their share of the samples of either (Jaccard)."""
    here = matrix.where(F.col("value") > threshold).select("contig_id", "sample")
    n = here.groupBy("contig_id").agg(F.count(F.lit(1)).alias("n"))
    a, b = _blocks(here)
    pairs = a.join(b, (F.col("a.meet") == F.col("b.meet")) & (F.col("a.sample") == F.col("b.sample")) & (F.col("a.contig_id") > F.col("b.contig_id")) & _once()).groupBy(F.col("a.contig_id").alias("contig_1"), F.col("b.contig_id").alias("contig_2")).agg(F.count(F.lit(1)).alias("shared_samples")).where(F.col("shared_samples") >= least)
    sized = pairs.join(n.select(F.col("contig_id").alias("contig_1"), F.col("n").alias("n1")), "contig_1").join(n.select(F.col("contig_id").alias("contig_2"), F.col("n").alias("n2")), "contig_2")
    return sized.select("contig_1", "contig_2", "shared_samples", (F.col("shared_samples") / (F.col("n1") + F.col("n2") - F.col("shared_samples"))).alias("shared_fraction"))


def selected_pairs(correlated: DataFrame, shared: DataFrame, mode: str = "both") -> DataFrame:
    """Pairs of one kind, or of both with the larger value of each column."""
    c = correlated.select("contig_1", "contig_2", "correlation", F.lit(None).cast("double").alias("shared_fraction"))
    s = shared.select("contig_1", "contig_2", F.lit(None).cast("double").alias("correlation"), "shared_fraction")
    rows = {"correlation": c, "cooccurrence": s, "both": c.union(s)}[mode]
    return rows.groupBy("contig_1", "contig_2").agg(F.max("correlation").alias("correlation"), F.max("shared_fraction").alias("shared_fraction"))


def groups(pairs: DataFrame) -> DataFrame:
    """Components of more than one contig, numbered by size (largest first), then first member."""
    part = connected_components(pairs, "contig_1", "contig_2")
    sets = part.groupBy("component").agg(F.count(F.lit(1)).alias("member_count"), F.array_sort(F.collect_list("id")).alias("m")).where("member_count > 1")
    numbered = number_rows(sets, [F.desc("member_count"), F.col("component")])[0]
    return numbered.select(F.concat(F.lit("group_"), F.col("_n").cast("string")).alias("group_id"), "member_count", F.array_join("m", ";").alias("members"))
