"""Connected components of an edge table, by contraction and a bounded last step."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import dealt, discard, materialize

#: Edges that one task solves at once: some tens of megabytes, whatever the input has.
LOCAL_EDGES = 1 << 20


def _solve(edges: DataFrame) -> DataFrame:
    """(u, f): every vertex of at most LOCAL_EDGES edges (u, v) and the least of its component."""
    kind = edges.schema["u"].dataType

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent.setdefault(up, up)
                x = up
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        ids = list(parent)
        for k in range(0, len(ids), 1 << 16):
            part = ids[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, types[0]), pa.array([root(x) for x in part], types[0])], names=["u", "f"])

    types = [pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string()]
    return edges.select("u", "v").coalesce(1).mapInArrow(union, f"u {kind.simpleString()}, f {kind.simpleString()}")


def _numbered(links: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and ids with a 64-bit number for each id; integers are their own number."""
    if ids.schema["id"].dataType.simpleString() != "string":
        return links.select(*[F.col(c).cast("long").alias(c) for c in "uv"]), ids.withColumn("k", F.col("id").cast("long"))
    known = materialize(ids.withColumn("k", F.monotonically_increasing_id()), "cc-ids")
    one, two = (dealt(known.select(F.col("id").alias(c), F.col("k").alias(f"k{c}"))) for c in "uv")
    return links.join(one, "u").join(two, "v").select(F.col("ku").alias("u"), F.col("kv").alias("v")), known


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", local: int = LOCAL_EDGES) -> DataFrame:
    """(id, component) for every vertex that has an edge; component is the least id reachable.

    While there are more than ``local`` edges, a round maps each vertex to the
    first of itself and its neighbours in an order that a hash draws anew for
    each round, and contracts the graph along this map: whatever the ids are,
    stars, chains and all else lose a constant share of their vertices in a
    round on average. The edges that are left, a bounded number, are solved
    by union-find in one task, which saves the long tail of small rounds; the
    maps are then followed back, from the smallest to the first. Only
    numbers of edges reach the driver, and no join is broadcast; every round
    ends in files of the shared folder, of which the ones no longer needed are deleted.

    Ends are 32- or 64-bit integers or strings. Null ends, self-loops and
    repeated edges have no effect beyond making their vertex known; an empty
    table gives no rows.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    named = materialize(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-edges")
    if named.count() <= local:
        return materialize(_solve(named).select(F.col("u").alias("id"), F.col("f").alias("component")), "cc-label")
    coded, ids = _numbered(named.where("u <> v"), named.select(F.col("u").alias("id")).union(named.select("v")).distinct())
    links, maps = materialize(coded, "cc-edges"), []
    while links.count() > local:
        # of one seed, the hash is a bijection of 64-bit integers: no two vertices tie
        luck = lambda c: F.xxhash64(F.lit(len(maps)), F.col(c))  # noqa: B023, E731
        ends = links.select("u", "v").union(links.select("v", "u"))
        near = ends.groupBy("u").agg(F.min_by("v", luck("v")).alias("m"))
        step = materialize(near.select("u", F.when(luck("u") < luck("m"), F.col("u")).otherwise(F.col("m")).alias("f")), "cc-step")
        moved = links.join(dealt(step), "u").select(F.col("f").alias("x"), "v").join(dealt(step.select(F.col("u").alias("v"), F.col("f").alias("y"))), "v").where("x <> y")
        fresh = materialize(moved.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "cc-edges")
        discard(links)
        links = fresh
        maps.append(step)
    label = materialize(_solve(links), "cc-label")
    discard(links)
    for step in reversed(maps):
        up = dealt(label.select(F.col("u").alias("f"), F.col("f").alias("g")))
        below = materialize(step.join(up, "f", "left").select("u", F.coalesce("g", "f").alias("f")), "cc-label")
        discard(label, step)
        label = below
    member = ids.join(dealt(label.withColumnRenamed("u", "k")), "k", "left").select("id", F.coalesce("f", "k").alias("f"))
    least = member.groupBy("f").agg(F.min("id").alias("component"))
    whole = materialize(member.join(dealt(least), "f").select("id", "component"), "cc-label")
    discard(label, ids, named)
    return whole
