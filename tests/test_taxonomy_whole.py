"""taxonomy_lca over all orders, against plain Python."""

from collections import defaultdict
from pathlib import Path

from strandframe.plans import catalog

SF = Path("/root/testdata/sf0.001")


def test_sets_hold_all_orders(spark):
    table = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").collect()
    parent = {0: None} | {1 + r.r_regionkey: 0 for r in table("region")} | {100 + r.n_nationkey: 1 + r.n_regionkey for r in table("nation")} | {100000 + r.c_custkey: 100 + r.c_nationkey for r in table("customer")}

    def up(x):
        path = []
        while x is not None:
            path.append(x)
            x = parent[x]
        return path

    sets = defaultdict(set)
    for r in table("orders"):
        if 100000 + r.o_custkey in parent:
            sets[f"{r.o_orderpriority}{r.o_orderkey % 200}"].add(100000 + r.o_custkey)
    want = {}
    for k, members in sets.items():
        shared = set.intersection(*(set(up(m)) for m in members))
        want[k] = next(a for a in up(min(members)) if a in shared)
    got = {r.set_id: r.lca for r in catalog.QUERIES["taxonomy_lca"](spark, str(SF)).collect()}
    assert got == want
