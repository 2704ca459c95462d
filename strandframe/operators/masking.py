"""Masks sequences by tables of ranges, and populates tables with sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as sq


def mask_by_table(sequences: DataFrame, id_: str, seq: str, ranges: DataFrame) -> DataFrame:
    """N over ranges (seq_id, start, stop, strand), 1-based and inclusive; on the
    minus strand, positions count on the reverse complement."""
    n = F.char_length(seq)
    lists = ranges.select(F.col("seq_id").alias(id_), F.struct(F.least("start", "stop").alias("start"), F.greatest("start", "stop").alias("stop"), F.coalesce("strand", F.lit("+")).alias("strand")).alias("r")).groupBy(id_).agg(F.array_sort(F.collect_list("r")).alias("_ranges"))
    place = lambda r: F.struct(F.when(r["strand"] == "-", n - r["stop"]).otherwise(r["start"] - 1).alias("start"), F.when(r["strand"] == "-", n - r["start"] + 1).otherwise(r["stop"]).alias("end"))
    joined = sequences.join(lists, id_, "left")
    masked = F.when(F.col("_ranges").isNull(), F.col(seq)).otherwise(sq.mask_ranges(F.col(seq), F.transform("_ranges", place)))
    return joined.select(*[masked.alias(c) if c == seq else c for c in sequences.columns])


def mask_by_alignments(sequences: DataFrame, id_: str, seq: str, intervals: DataFrame) -> DataFrame:
    """N over alignment intervals (rname, start, end), 1-based and inclusive, in forward coordinates."""
    return mask_by_table(sequences, id_, seq, intervals.select(F.col("rname").alias("seq_id"), "start", F.col("end").alias("stop"), F.lit("+").alias("strand")))


def populate(table: DataFrame, sequences: DataFrame, key: str, id_: str, seq: str, start: Column | None = None, end: Column | None = None, reverse: Column | None = None) -> DataFrame:
    """The table with each row's sequence (null if unknown), cut and turned where asked."""
    joined = table.join(sequences.select(F.col(id_).alias(key), F.col(seq).alias("_full")), key, "left")
    full = F.col("_full")
    cut = full if start is None else sq.trim_region(full, start, end, reverse)
    return joined.withColumn("sequence", cut).drop("_full")


def repeat_risk(df: DataFrame, id_: str, seq: str, edge: int = 40, least: float = 0.95, fraction: float = 0.40, least_length: int = 0) -> DataFrame:
    """Reasons why a sequence is likely repetitive, joined by commas: direct or
    inverted terminal repeats, or one self-similar track over ``fraction`` of it."""
    s, n = F.col(seq), F.char_length(seq)
    span = F.least(F.lit(edge), F.floor(n / 2)).cast("int")
    head, tail = F.left(s, span), F.right(s, span)
    long_enough = n >= F.greatest(F.lit(2 * 9), F.lit(least_length))
    reasons = F.array(
        F.when((span > 0) & (sq.identity_at(head, tail) >= least), F.lit("direct_terminal_repeat")),
        F.when((span > 0) & (sq.identity_at(head, sq.revcomp(tail)) >= least), F.lit("inverted_terminal_repeat")),
        F.when(long_enough & (sq.track_span(s) >= n * fraction), F.lit("self_repeat")),
        F.when(long_enough & (sq.track_span(s, inverted=True) >= n * fraction), F.lit("inverted_self_repeat")),
    )
    return df.select(F.col(id_).alias("seq_id"), F.array_join(F.array_compact(reasons), ",").alias("reasons")).withColumn("risky", F.col("reasons") != "")
