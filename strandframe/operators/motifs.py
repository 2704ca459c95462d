"""Combination of motif hits into one set per query, and their summaries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The score that a motif type must exceed.
LEAST = {"A": 10.0, "B": 11.0, "C": 5.9, "D": 5.0}
OUT = "query_name string, total_score double, motif_types string, first long, last long, n_motifs int"


def type_of_motif(hits: DataFrame, details: DataFrame, profile: str = "motif_profile") -> DataFrame:
    """Adds motif_type by profile; details (profile, motif_type) is a small table of the database."""
    return hits.join(F.broadcast(details.select(F.col("profile").alias(profile), "motif_type").dropDuplicates([profile])), profile, "left")


def combine(hits: DataFrame, distance: int = 200, least: dict[str, float] | None = None) -> DataFrame:
    """The best set of non-overlapping motifs of one type each, all within ``distance`` of one another.

    Greedy from each hit in turn, best first; the highest total wins, then the
    earlier start. Hits are sorted by query inside the partitions, so Python is
    called once a partition and holds one query at a time.
    """
    least = LEAST if least is None else least
    order = hits.select("query_name", "motif_type", F.col("ali_from").cast("long").alias("s"), F.col("ali_to").cast("long").alias("e"), F.col("score").cast("double").alias("score")).where(" or ".join(f"(motif_type = '{t}' and score > {v})" for t, v in least.items()))
    dealt = order.repartition("query_name").sortWithinPartitions("query_name", F.desc("score"), "s", "e", "motif_type")

    def total(chosen: list[tuple]) -> float:
        """One addition after the other, in the order of choice: sum() makes up for what rounding loses, and totals that the definition tells apart would tie."""
        return reduce(lambda a, c: a + c[3], chosen[1:], chosen[0][3])

    def best(rows: list[tuple]) -> tuple:
        top = None
        for k in range(len(rows)):
            chosen = [rows[k]]
            for r in rows:
                apart = all(r[1] > c[2] or r[2] < c[1] for c in chosen)
                near = all(max(r[1] - c[2], c[1] - r[2]) <= distance for c in chosen)
                if r[0] not in {c[0] for c in chosen} and apart and near:
                    chosen.append(r)
            key = (-total(chosen), min(c[1] for c in chosen))
            if top is None or key < top[0]:
                top = (key, chosen)
        chosen = sorted(top[1], key=lambda c: c[1])
        return (-top[0][0], ";".join(sorted(c[0] for c in chosen)), chosen[0][1], max(c[2] for c in chosen), len(chosen))

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows = None, []
        for pdf in frames:
            out = []
            for q, t, s, e, score in pdf.itertuples(index=False):
                if q != now and rows:
                    out.append((now, *best(rows)))
                    rows = []
                now = q
                rows.append((t, s, e, score))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        if rows:
            yield pd.DataFrame([(now, *best(rows))], columns=[c.split()[0] for c in OUT.split(", ")])

    return dealt.mapInPandas(scan, OUT)


def summary(hits: DataFrame, nested: bool = True) -> DataFrame:
    """Per query: sorted motif types, largest coordinate, and details by type (map of arrays), or best score by type."""
    base = [F.array_join(F.array_sort(F.collect_set("motif_type")), ";").alias("motif_types"), F.max("ali_to").alias("length")]
    if not nested:
        return hits.groupBy("query_name").pivot("motif_type", sorted(LEAST)).agg(F.max("score"))
    detail = F.struct(F.col("ali_from").alias("start"), F.col("ali_to").alias("end"), "score", "evalue", F.col("motif_profile").alias("profile"))
    per = hits.groupBy("query_name", "motif_type").agg(F.array_sort(F.collect_list(detail)).alias("d"))
    maps = per.groupBy("query_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("motif_type", "d")))).alias("details"))
    return hits.groupBy("query_name").agg(*base).join(maps, "query_name").withColumn("details_json", F.to_json("details"))
