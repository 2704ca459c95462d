"""Taxonomy trees as (tax_id, parent_tax_id, rank, scientific_name) tables.

A tree becomes its ancestor closure (tax_id, ancestor, distance) by doubling:
each round joins the closure with itself, so a tree of depth d takes log2(d)
rounds. A root is its own parent or has none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def closure(nodes: DataFrame) -> DataFrame:
    """tax_id, ancestor and distance, each node with itself at 0."""
    own = nodes.select("tax_id", F.col("tax_id").alias("ancestor"), F.lit(0).alias("distance"))
    up = nodes.where("parent_tax_id is not null and parent_tax_id <> tax_id").select("tax_id", F.col("parent_tax_id").alias("ancestor"), F.lit(1).alias("distance"))
    found, reach = materialize(own.union(up), "closure"), 1
    while True:
        far = found.where(F.col("distance") == reach)
        more = far.join(found.where("distance > 0").select(F.col("tax_id").alias("ancestor"), F.col("ancestor").alias("top"), F.col("distance").alias("d")), "ancestor").select("tax_id", F.col("top").alias("ancestor"), (F.col("distance") + F.col("d")).alias("distance"))
        more = materialize(more, "closure")
        if more.isEmpty():
            return found
        found, reach = materialize(found.union(more), "closure"), reach * 2


def lineage(nodes: DataFrame, closed: DataFrame, separator: str = ";") -> DataFrame:
    """tax_id and the names from the root down."""
    named = closed.join(nodes.select(F.col("tax_id").alias("ancestor"), "scientific_name"), "ancestor")
    path = F.sort_array(F.collect_list(F.struct("distance", "scientific_name")), asc=False)
    return named.groupBy("tax_id").agg(F.array_join(F.transform(path, lambda x: x["scientific_name"]), separator).alias("lineage"))


def has_data(value: Column) -> Column:
    """Not null and none of the ways to say nothing."""
    return value.isNotNull() & ~F.trim(value.cast("string")).isin("", "na", "NA", "-")


def propagate(closed: DataFrame, leaves: DataFrame, method: str = "any") -> DataFrame:
    """Availability of inner nodes from (tax_id, available): any, count, or majority of the nodes below that are known."""
    up = closed.join(leaves.select("tax_id", F.col("available").cast("boolean").alias("available")), "tax_id")
    value = {"any": F.bool_or("available"), "count": F.count_if("available"), "majority": F.count_if("available") * 2 > F.count(F.lit(1))}[method]
    return up.groupBy(F.col("ancestor").alias("tax_id")).agg(value.alias("available"))


def nearest_ancestor(closed: DataFrame, queries: DataFrame, available: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """The closest ancestor (itself included) with data; ``within`` limits the ranks by their tax_ids."""
    good = available.where("available").select(F.col("tax_id").alias("ancestor"))
    good = good if within is None else good.join(within.select(F.col("tax_id").alias("ancestor")), "ancestor", "left_semi")
    return queries.select("tax_id").join(closed, "tax_id").join(good, "ancestor").groupBy("tax_id").agg(F.min(F.struct("distance", "ancestor")).alias("x")).select("tax_id", F.col("x.ancestor").alias("ancestor"), F.col("x.distance").alias("distance"))


def nearest_leaf(closed: DataFrame, queries: DataFrame, available: DataFrame, most: int = 10) -> DataFrame:
    """The closest other node with data: up to a common ancestor, then down; nearer first, then less up, then id."""
    good = available.where("available").select(F.col("tax_id").alias("leaf"))
    down = closed.select(F.col("tax_id").alias("leaf"), "ancestor", F.col("distance").alias("down")).join(good, "leaf")
    # only the best leaf below each ancestor can win, but for the query itself: keep two
    two = down.withColumn("_r", F.row_number().over(Window.partitionBy("ancestor").orderBy("down", "leaf"))).where("_r <= 2").drop("_r")
    path = queries.select("tax_id").join(closed, "tax_id").join(two, "ancestor").where("leaf <> tax_id").withColumn("total", F.col("distance") + F.col("down")).where(F.col("total") <= most)
    return path.groupBy("tax_id").agg(F.min(F.struct("total", "distance", "leaf")).alias("x")).select("tax_id", F.col("x.leaf").alias("leaf"), F.col("x.total").alias("distance"))


def lowest_common_ancestor(closed: DataFrame, sets: DataFrame) -> DataFrame:
    """set_id and the deepest node above all of its members; sets: set_id, tax_id."""
    size = sets.distinct().groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    shared = sets.distinct().join(closed, "tax_id").groupBy("set_id", "ancestor").agg(F.count(F.lit(1)).alias("k"), F.sum("distance").alias("far")).join(size, "set_id").where("k = n")
    return shared.groupBy("set_id").agg(F.min(F.struct("far", "ancestor"))["ancestor"].alias("lca"))


def rank_stats(nodes: DataFrame, available: DataFrame) -> DataFrame:
    """Nodes of each rank, and those with data."""
    j = nodes.join(available.select("tax_id", "available"), "tax_id", "left")
    return j.groupBy("rank").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.coalesce("available", F.lit(False))).alias("with_data"))


def select_genomes(mapping: DataFrame, kinds: list[str], most: int | None = None) -> DataFrame:
    """Genomes of each queried taxon: itself first, then ancestors, then relatives; the first ``most`` taxa."""
    order = reduce(lambda c, k: c.when(F.col("relationship") == k[1], k[0]), enumerate(("self", "ancestor", "relative")), F.when(F.lit(False), -1))
    ranked = mapping.where(F.col("relationship").isin(kinds)).withColumn("_r", F.row_number().over(Window.partitionBy("query_tax_id").orderBy(order, "reference_name", "ftp_path"))).where("_r = 1").drop("_r")
    return ranked.join(ranked.select("query_tax_id").distinct().orderBy("query_tax_id").limit(most), "query_tax_id", "left_semi") if most else ranked
