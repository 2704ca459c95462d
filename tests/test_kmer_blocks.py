"""Pairs of sequences by shared k-mers, over one block and over many, against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import kmers


@pytest.mark.parametrize("block", [60, 1 << 20])
def test_pairs_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(kmers, "BLOCK", block)
    monkeypatch.setattr(kmers, "AT_ONCE", 50)
    dice = random.Random(3)
    seqs = {f"s{k}": "".join(dice.choice("ACGT") for _ in range(dice.randrange(0, 25))) for k in range(40)}
    seqs |= {"copy": seqs["s1"], "none": None, "other": "éééé"}
    df = spark.createDataFrame(list(seqs.items()), "id string, s string")
    sets = {i: {s[j : j + 3] for j in range(len(s) - 2)} for i, s in seqs.items() if s}
    want = {(a, b): (n, round(n / min(len(sets[a]), len(sets[b])), 4)) for a in sets for b in sets if a < b and (n := len(sets[a] & sets[b])) >= 2 and n / min(len(sets[a]), len(sets[b])) >= 0.3}
    out = kmers.kmer_overlap(df, "id", "s", 3, 0.3, canonical=False, least_shared=2, skip_ambiguous=False)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.seq_a, r.seq_b): (r.shared, r.overlap) for r in out.collect()} == want
    assert kmers.kmer_overlap(df.where(F.lit(False)), "id", "s", 3).count() == 0
