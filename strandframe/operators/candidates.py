"""Candidate pairs of two marker types with the evidence that links them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complementarity(df: DataFrame) -> DataFrame:
    """Flags from the ends that two sequences share: same, opposite, both, none."""
    same = F.coalesce(F.col("a_group_5") == F.col("b_group_5"), F.lit(False)), F.coalesce(F.col("a_group_3") == F.col("b_group_3"), F.lit(False))
    cross = F.coalesce(F.col("a_group_5") == F.col("b_group_3"), F.lit(False)), F.coalesce(F.col("a_group_3") == F.col("b_group_5"), F.lit(False))
    return df.withColumns({"shares_5prime": same[0], "shares_3prime": same[1], "shares_both_ends": same[0] & same[1], "crosses_ends": cross[0] | cross[1], "shares_none": ~(same[0] | same[1] | cross[0] | cross[1])})


def candidate_pairs(pairs: DataFrame, sides: list[DataFrame], both: list[DataFrame] | None = None, strict: str | None = None) -> DataFrame:
    """pairs (a, b) with every table of ``sides`` joined to each end and every
    table of ``both`` joined to the pair, all from the left.

    A side table has ``id`` and columns that become a_... and b_...; small ones
    are broadcast by Spark's own size check. ``strict`` is an SQL condition.
    """
    out = pairs
    for side in sides:
        for end in ("a", "b"):
            out = out.join(side.select(F.col("id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in side.columns if c != "id"]), end, "left")
    out = reduce(lambda df, t: df.join(t, ["a", "b"], "left"), both or [], out)
    return out.where(strict) if strict else out
