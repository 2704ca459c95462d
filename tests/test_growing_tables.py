"""Steps whose cost must follow the size of their input: what they plan and what they read."""

import io
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandframe.functions import sequence as sq
from strandframe.operators import intervals, kmers
from strandframe.sources import fastx

TURN = str.maketrans("ACGT", "TGCA")


def test_canonical_kmers_are_counted_in_the_row(spark):
    texts = {1: "ACGTTGCAACGT", 2: "ééACGTN", 3: "AC", 4: None, 5: "", 6: "TTTTAAAA"}
    df = spark.createDataFrame(list(texts.items()), "id long, s string")
    out = kmers.kmer_counts(df, "id", "s", 4, canonical=True, relative=True)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = {}
    for i, t in texts.items():
        words = [(t or "")[j : j + 4] for j in range(len(t or "") - 3)]
        for w, n in Counter(min(w, w[::-1].translate(TURN)) for w in words).items():
            want[i, w] = (n, pytest.approx(n / len(words)))
    assert {(r.id, r.kmer): (r.n, r.share) for r in out.collect()} == want


def test_short_ranges_of_fasta_stay_few(spark, tmp_path):
    records = {f"p{k}": "ACGT" * (k % 9 + 1) for k in range(20_000)}
    (tmp_path / "a.fasta").write_text("".join(f">{h}\n{s}\n" for h, s in records.items()))
    cut = fastx.FastxReader({"path": str(tmp_path), "splitbytes": "100"}).partitions()
    assert len(cut) <= fastx.MOST_RANGES
    assert (cut[0].start, cut[-1].end) == (0, (tmp_path / "a.fasta").stat().st_size)
    assert all(a.end == b.start for a, b in zip(cut, cut[1:], strict=False))
    got = fastx.read_fastx(spark, str(tmp_path), split_bytes=100)
    assert {r.header: r.sequence for r in got.collect()} == records


def test_a_range_reads_little_beyond_its_end():
    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            Counted.taken += len(chunk := super().read(n))
            return chunk

    stream = Counted(b">x\nACGT\n" * 200_000)
    assert sum(line == b">x" for line in fastx._lines(stream, 8000, 16_000)) == 1000
    assert Counted.taken < 30_000


def test_codon_usage_is_counted_once_a_text(spark):
    texts = ["ATGatgNNNAT", "", None, "éé\U0001f600ACGééé\U0001f600", "AN", "TTTtttCCCANA"]
    df = spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1)
    usage = df.select("s", sq.codon_usage(F.col("s")).alias("u"))
    assert "lambdafunction" not in usage._jdf.queryExecution().optimizedPlan().toString()
    for r in usage.collect():
        if r.s is None:
            assert r.u is None
            continue
        upper = "".join(c.upper() if c.isascii() else c for c in r.s)
        found = Counter(c for c in (upper[k : k + 3] for k in range(0, len(upper) - 2, 3)) if "N" not in c)
        assert r.u == {c: pytest.approx(n / found.total()) for c, n in found.items()}


def test_tasks_of_polyproteins_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(intervals, "TASK_HITS", 100)
    hits = spark.range(1000).selectExpr("id % 20 as q", "id as t", "id % 7 * 50 as s", "id % 7 * 50 + 20 as e", "400L as qlen")
    out = intervals.polyproteins(hits, "q", "t", "s", "e", "qlen")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(q" in plan and ", 10)" in plan and "Broadcast" not in plan
    assert plan.count("Exchange hash") == plan.count(", REPARTITION_BY_NUM")
    assert {r.q for r in out.collect()} == set(range(20))
    assert intervals.adaptive_limit(hits, "q", "t", "s", "e", "qlen").first()[0] == 5
