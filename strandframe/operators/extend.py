"""Extends the longest sequence of each cluster by ungapped terminal overlaps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

K, WINDOW, SHARED, OVERLAP, IDENTITY, FRACTION = 9, 250, 2, 50, 0.98, 0.60
OUT = "cluster_id string, contig_id string, is_representative boolean, order int, extended string"


def best_overlap(left: str, right: str, window: int = WINDOW, least: int = OVERLAP, identity: float = IDENTITY, k: int = K, shared: int = SHARED) -> tuple[float, int] | None:
    """Identity and length of the best overlap of left's suffix with right's prefix.

    Only pairs whose ends share ``shared`` k-mers are compared; longer overlaps
    win among those of one identity.
    """
    tail, head = left[-window:], right[:window]
    grams = {tail[i : i + k] for i in range(len(tail) - k + 1)}
    if len(grams & {head[i : i + k] for i in range(len(head) - k + 1)}) < shared:
        return None
    found = None
    for n in range(least, min(len(tail), len(head)) + 1):
        same = sum(a == b for a, b in zip(tail[-n:], head[:n], strict=True)) / n
        if same >= identity and (found is None or (same, n) > found):
            found = (same, n)
    return found


def extend_clusters(df: DataFrame, cluster: str = "cluster_id", id_: str = "contig_id", seq: str = "sequence", **limits: float) -> DataFrame:
    """Per cluster: from its longest member, the member that overlaps best at
    either end is added until none does; ``order`` says when (-1: not used).

    Members of one cluster are compared with each other, so a cluster is one
    group; clusters run in parallel.
    """

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["contig_id"], pdf["sequence"], strict=True), key=lambda r: (-len(r[1]), r[0]))
        start, joined = rows[0]
        order, rest = {start: 0}, dict(rows[1:])
        while rest:
            choices = []
            for name, s in rest.items():
                for side, hit in (("r", best_overlap(joined, s, **limits)), ("l", best_overlap(s, joined, **limits))):
                    if hit and len(s) > hit[1]:
                        choices.append((-hit[0], -hit[1], name, side))
            if not choices:
                break
            _, n, name, side = min(choices)
            s = rest.pop(name)
            size = -n  # of the overlap
            joined = joined + s[size:] if side == "r" else s[: len(s) - size] + joined
            order[name] = len(order)
        return pd.DataFrame([(pdf["cluster_id"].iloc[0], name, name == start, order.get(name, -1), joined if name == start else None) for name, _ in rows], columns=[c.split()[0] for c in OUT.split(", ")])

    return df.select(df[cluster].cast("string").alias("cluster_id"), df[id_].cast("string").alias("contig_id"), df[seq].alias("sequence")).where("sequence is not null").groupBy("cluster_id").applyInPandas(grow, OUT)
