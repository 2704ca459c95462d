"""Names, headers and the operators mended in this round, on small tables."""

import pytest
from pyspark.sql import functions as F

from strandframe.functions import names
from strandframe.functions import sequence as sq
from strandframe.operators import kmers, tables
from strandframe.operators.components import connected_components


def test_memory_and_file_pairs():
    assert [names.memory_bytes(x) for x in ("6gb", "512 MB", "2.5G", "10", "1kib")] == [6 << 30, 512 << 20, 5 << 29, 10, 1024]
    with pytest.raises(ValueError, match="memory"):
        names.memory_bytes("much")
    assert names.mate_file("a_R1.fastq.gz") == "a_R2.fastq.gz" and names.mate_file("a.1.fq") == "a.2.fq" and names.mate_file("a.fq") is None
    assert names.pair_files(["a_R1.fq", "a_R2.fq", "b_1.fq", "c.fq"]) == ([("a_R1.fq", "a_R2.fq")], ["b_1.fq", "c.fq"])


@pytest.mark.parametrize("order", [["k"], ["k", "v"]])
def test_deduplicate_with_repeated_ids(spark, order):
    rows = [(1, "x"), (1, "x"), (2, "x"), (3, "y"), (3, "x"), (None, "z"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "k long, v string").repartition(3)
    got = sorted((r.k or 0, r.v or "") for r in tables.deduplicate(df, F.col("v"), order).collect())
    assert got == [(0, "z"), (1, "x"), (3, "y"), (4, "")]


def test_kmers_inside_rows(spark):
    texts = {1: "AACAAC", 2: "", 3: None, 4: "AC", 5: "é€𝄞é€𝄞é", 6: "acgtACGTacgt" * 50}
    df = spark.createDataFrame(list(texts.items()), "id long, s string").repartition(2)
    for k in (1, 2, 3, 12):
        got = {(r.id, r.kmer): (r.n, round(r.share, 9)) for r in kmers.kmer_counts(df, "id", "s", k, relative=True).collect()}
        want = {}
        for i, t in texts.items():
            own = "".join(c.upper() if c.isascii() else c for c in t or "")
            for at in range(len(own) - k + 1):
                want[i, own[at : at + k]] = want.get((i, own[at : at + k]), 0) + 1
        total = {i: len(t or "") - k + 1 for i, t in texts.items()}
        assert got == {key: (n, round(n / total[key[0]], 9)) for key, n in want.items()}


@pytest.mark.parametrize("local", [0, 3, 1 << 20])
def test_components_with_and_without_a_local_end(spark, local):
    edges = [(k, k + 1) for k in range(40) if k % 10] + [(100, 100), (200, 201), (201, 200), (None, 5)] + [(300, 300 + k) for k in range(1, 30)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long"), local=local).collect()}
    want = {}
    for a, b in edges:
        if a is not None:
            want.setdefault(a, a), want.setdefault(b, b)
    for _ in want:
        for a, b in edges:
            if a is not None:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_strands_and_gaps(spark):
    df = spark.createDataFrame([("acgtt",), ("é-AC",), (None,)], "s string")
    assert [r[0] for r in df.select(sq.least_strand(F.col("s"))).collect()] == ["AACGT", "GT-é", None]
    assert spark.createDataFrame([("ATG---AA-",)], "s string").select(sq.translate(F.col("s"))).first()[0] == "m-X"
