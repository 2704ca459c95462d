"""Totals are added one after the other, so sets whose exact sums tie are told apart as in the SQL."""

import duckdb
from pyspark.sql import functions as F

from strandframe.plans import catalog

SCORES = {100: [198.51, 56.02, 32.67], 700: [174.34, 95.58, 17.28]}


def test_totals_that_differ_by_rounding_only(spark, tmp_path):
    rows = []
    for start, scores in SCORES.items():
        for kind, score in enumerate(scores):
            at = start + 30 * kind
            rows.append((next(i for i in range(4000) if i % 4 == kind and at <= i * 37 % 900 < at + 10), 7, "view", score))
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").withColumn("props", F.lit("{}"))
    events.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    columns = ["query_name", "total_score", "motif_types", "first", "last", "n_motifs"]
    want = duck.execute(f"select {', '.join(columns)} from ({catalog.ORACLES['motif_combination']})").fetchall()
    assert [tuple(r) for r in catalog.QUERIES["motif_combination"](spark, str(tmp_path)).select(columns).collect()] == want
    assert want[0][3] >= 700
