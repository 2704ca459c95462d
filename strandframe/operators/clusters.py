"""Clusters of sequences from edges: components, greedy centroids, summaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import dealt, materialize
from .components import connected_components
from .tables import number_rows

ASSIGNMENT = "seq_id string, cluster_id string, representative_id string, is_representative boolean"


def _number(groups: DataFrame, order: list[Column]) -> DataFrame:
    """A running number from 0 for each cluster."""
    return number_rows(groups, order)[0].withColumn("_n", F.col("_n") - 1)


def component_clusters(nodes: DataFrame, edges: DataFrame, excluded: DataFrame | None = None, prefix: str = "cluster_") -> DataFrame:
    """Assignments by connected components.

    nodes: seq_id. The representative is the first member by id that is not
    excluded (the first of all if none is left); clusters are numbered by their
    least member. Members without an edge are clusters of one.
    """
    ids = nodes.select("seq_id").distinct()
    part = connected_components(edges, "query_id", "target_id")
    member = ids.join(dealt(part.select(F.col("id").alias("seq_id"), "component")), "seq_id", "left").select("seq_id", F.coalesce("component", "seq_id").alias("root"))
    barred = member.withColumn("_bad", F.lit(0)) if excluded is None else member.join(dealt(excluded.select("seq_id").distinct().withColumn("_out", F.lit(1))), "seq_id", "left").withColumn("_bad", F.coalesce("_out", F.lit(0))).drop("_out")
    rep = barred.groupBy("root").agg(F.min(F.struct("_bad", "seq_id"))["seq_id"].alias("representative_id"))
    named = _number(rep, [F.col("root")]).select("root", "representative_id", F.concat(F.lit(prefix), F.col("_n").cast("string")).alias("cluster_id"))
    return barred.join(dealt(named), "root").select("seq_id", "cluster_id", "representative_id", (F.col("seq_id") == F.col("representative_id")).alias("is_representative"))


def centroid_clusters(nodes: DataFrame, edges: DataFrame, excluded: DataFrame | None = None, prefix: str = "cluster_") -> DataFrame:
    """Greedy centroids: by length (longest first, then id; excluded last) a
    sequence joins the earliest centroid next to it, else becomes one.

    nodes: seq_id, length. Components are independent, so each is one group;
    inside, the greedy order is kept. Sequences without edges never reach Python.
    """
    ids = nodes.select("seq_id", "length")
    ids = ids.withColumn("_bad", F.lit(0)) if excluded is None else ids.join(dealt(excluded.select("seq_id").distinct().withColumn("_out", F.lit(1))), "seq_id", "left").select("seq_id", "length", F.coalesce("_out", F.lit(0)).alias("_bad"))
    part = connected_components(edges, "query_id", "target_id").withColumnRenamed("id", "seq_id")
    linked = ids.join(dealt(part), "seq_id")
    both = edges.select(F.col("query_id").alias("seq_id"), F.col("target_id").alias("other")).union(edges.select("target_id", "query_id")).where("seq_id <> other").distinct()
    near = linked.join(dealt(both.groupBy("seq_id").agg(F.collect_list("other").alias("near"))), "seq_id")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_bad", "length", "seq_id"], ascending=[True, False, True])
        order, out = {}, []
        for seq, others in zip(pdf["seq_id"], pdf["near"], strict=True):
            found = [order[o] for o in others if o in order]
            if found:
                out.append((seq, min(found)[1]))
            else:
                order[seq] = (len(order), seq)
                out.append((seq, seq))
        return pd.DataFrame(out, columns=["seq_id", "representative_id"])

    joined = near.groupBy("component").applyInPandas(greedy, "seq_id string, representative_id string")
    alone = ids.join(dealt(both.select("seq_id").distinct()), "seq_id", "left_anti").select("seq_id", F.col("seq_id").alias("representative_id"))
    member = materialize(joined.union(alone), "centroids")
    heads = member.where("seq_id = representative_id").select("representative_id").join(dealt(ids.withColumnRenamed("seq_id", "representative_id")), "representative_id")
    named = _number(heads, [F.col("_bad"), F.desc("length"), F.col("representative_id")])
    return member.join(dealt(named.select("representative_id", F.concat(F.lit(prefix), F.col("_n").cast("string")).alias("cluster_id"))), "representative_id").select("seq_id", "cluster_id", "representative_id", (F.col("seq_id") == F.col("representative_id")).alias("is_representative"))


def with_edge_values(assigned: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds identity and coverage to the representative (best edge of either direction, its lesser coverage; 100 for itself)."""
    cov = F.least("query_coverage", "target_coverage").alias("cov")
    both = edges.select("query_id", "target_id", "identity", cov).union(edges.select("target_id", "query_id", "identity", cov))
    best = both.groupBy(F.col("query_id").alias("seq_id"), F.col("target_id").alias("representative_id")).agg(F.max("identity").alias("i"), F.max("cov").alias("c"))
    value = lambda c: F.when(F.col("is_representative"), F.lit(100.0)).otherwise(F.col(c))
    return assigned.join(dealt(best), ["seq_id", "representative_id"], "left").withColumns({"identity_to_representative": value("i"), "coverage_to_representative": value("c")}).drop("i", "c")


def cluster_summary(assigned: DataFrame) -> DataFrame:
    """cluster_id, representative, member_count and members with the representative first."""
    members = F.array_sort(F.collect_list(F.struct((~F.col("is_representative")).alias("o"), F.col("seq_id").alias("s"))))
    return assigned.groupBy("cluster_id").agg(F.min("representative_id").alias("representative_id"), F.count(F.lit(1)).alias("member_count"), F.array_join(F.transform(members, lambda m: m["s"]), ";").alias("members"))


def cluster_stats(assigned: DataFrame) -> DataFrame:
    sizes = assigned.groupBy("cluster_id").agg(F.count_distinct("seq_id").alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("sequences"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"))


def marker_summary(assigned: DataFrame, info: DataFrame) -> DataFrame:
    """Counts by marker type and samples of each cluster; info: seq_id, marker_type, sample_id, seq_length."""
    j = assigned.join(dealt(info), "seq_id", "left")
    return j.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("member_count"),
        F.count_if(F.col("marker_type") == "a").alias("n_a"),
        F.count_if(F.col("marker_type") == "b").alias("n_b"),
        F.count_distinct("sample_id").alias("n_samples"),
        F.min_by("seq_id", F.struct(-F.col("seq_length"), "seq_id")).alias("longest_member"),
        F.coalesce(F.bool_or(F.col("marker_type") == "a"), F.lit(False)).alias("has_a"),
    )


def presence_matrix(rows: DataFrame, row: str, column: str, values: list | None = None) -> DataFrame:
    """Wide 0/1 table of which column values a row has."""
    return rows.select(row, column).distinct().withColumn("_one", F.lit(1)).groupBy(row).pivot(column, values).agg(F.first("_one")).na.fill(0)


def representatives(sequences: DataFrame, assigned: DataFrame, id_: str) -> DataFrame:
    return sequences.join(dealt(assigned.where("is_representative").select(F.col("seq_id").alias(id_))), id_, "left_semi")


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """How far two assignments (seq_id, cluster_id) agree, over all pairs they place together.

    Pairs are counted by sizes of cells, never listed: a cell of n sequences has
    n*(n-1)/2 pairs.
    """
    j = a.select("seq_id", F.col("cluster_id").alias("ca")).join(dealt(b.select("seq_id", F.col("cluster_id").alias("cb"))), "seq_id")
    pairs = lambda *keys: j.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.lit(0.0)).alias("p"))
    both, one, two = pairs("ca", "cb").withColumnRenamed("p", "both_pairs"), pairs("ca").withColumnRenamed("p", "a_pairs"), pairs("cb").withColumnRenamed("p", "b_pairs")
    out = both.crossJoin(one).crossJoin(two)  # one row each
    union = F.col("a_pairs") + F.col("b_pairs") - F.col("both_pairs")
    return out.withColumn("jaccard", F.round(F.try_divide(F.col("both_pairs"), union), 6)).withColumn("disagreeing", union - F.col("both_pairs"))


def size_deltas(a: DataFrame, b: DataFrame) -> DataFrame:
    """Median and 90th percentile of the difference of cluster sizes that a sequence sees."""
    sized = lambda df, n: df.join(dealt(df.groupBy("cluster_id").agg(F.count(F.lit(1)).alias(n))), "cluster_id").select("seq_id", n)
    j = sized(a, "na").join(dealt(sized(b, "nb")), "seq_id").select(F.abs(F.col("na") - F.col("nb")).alias("d"))
    return j.agg(F.percentile("d", 0.5).alias("median_delta"), F.percentile("d", 0.9).alias("p90_delta"))
