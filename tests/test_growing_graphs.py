"""Graphs beyond what one task solves: rounds stay few, nothing is broadcast, results stay those of the definition."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import clusters, components
from strandframe.operators.components import connected_components


def plain(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize("kind", ["string", "long", "int"])
def test_contraction(spark, kind):
    dice = random.Random(5)
    name = str if kind == "string" else int
    chain = [(k, k + 1) for k in range(200, 260)]
    edges = chain + [(400, k) for k in range(401, 440)] + [(dice.randrange(500, 600), dice.randrange(500, 600)) for _ in range(80)] + [(700, 700), (1, 0), (0, 1)]
    edges = [(name(a), name(b)) for a, b in edges]
    df = spark.createDataFrame(edges, f"src {kind}, dst {kind}")
    assert {r.id: r.component for r in connected_components(df, local=3).collect()} == plain(edges)


def test_rounds_on_a_sorted_chain_are_few(spark, monkeypatch):
    steps = []
    materialize = components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label="t", *a: (steps.append(label), materialize(df, label, *a))[1])
    chain = spark.range(1000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert connected_components(chain, local=40).where("component = 0").count() == 1001
    assert steps.count("cc-step") <= 12


def test_no_join_of_clusters_is_broadcast(spark):
    nodes = spark.range(60).select(F.col("id").cast("string").alias("seq_id"), F.col("id").alias("length"))
    edges = spark.range(40).select(F.col("id").cast("string").alias("query_id"), (F.col("id") + 1).cast("string").alias("target_id"))
    info = nodes.select("seq_id", F.lit("a").alias("marker_type"), F.lit("s").alias("sample_id"), F.lit(1).alias("seq_length"))
    assigned = clusters.component_clusters(nodes, edges)
    for df in (assigned, clusters.marker_summary(assigned, info), clusters.centroid_clusters(nodes, edges)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        # the offsets of partitions, one number each, are all that is broadcast
        assert plan.count("BroadcastHashJoin") == 1
        assert "SortMergeJoin" in plan
