"""Hand-made cases and properties of the operators."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from strandframe.functions import sequence as sq
from strandframe.operators import clusters, correlate, extend, filters, hits, intervals, kmers, masking, motifs, tables, taxonomy, termini
from strandframe.operators.components import connected_components
from strandframe.sources import fastx, tabular
from strandframe.streaming import online


def one(spark, column, **values):
    names = ", ".join(f"{'null' if v is None else repr(v)} as {k}" for k, v in values.items())
    return spark.sql(f"select {names or 1}").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("call", "seq", "want"),
    [
        (sq.gc_content, "GGccAT", 4 / 6),
        (sq.gc_content, "", None),
        (sq.gc_content, None, None),
        (sq.n_count, "NnA", 2),
        (sq.seq_length, "ä", 2),
        (sq.avg_quality, "!I", 20.0),
        (sq.revcomp, "ACGTN", "NACGT"),
        (sq.revcomp, "AUx", "xAT"),
        (sq.canonical_kmer, "TTG", "CAA"),
        (lambda c: sq.kmers(c, 2), "ABC", ["AB", "BC"]),
        (lambda c: sq.kmers(c, 4), "ABC", []),
        (lambda c: sq.kmers(c, 2, True), "ACNGT", ["AC", "GT"]),
        (sq.translate, "ATGAAATAG", "mK*"),
        (sq.translate, "AUG AA", "m"),
        (lambda c: sq.translate(c, 2), "CATGA", "m"),
        (lambda c: sq.translate(c, -1), "CTATTTCAT", "mK*"),
        (lambda c: sq.translate(c, 1, 2), "TGAAGA", "W*"),
        (sq.translate, "AC", ""),
        (sq.translate, None, None),
        (sq.guess_alphabet, "ACGU", "nucl"),
        (sq.guess_alphabet, "MKL", "amino"),
        (sq.least_rotation, "cab", "abc"),
        (sq.least_rotation, "", ""),
        (lambda c: sq.mask_range(c, F.lit(1), F.lit(3)), "ACGT", "ANNT"),
        (lambda c: sq.mask_range(c, F.lit(2), F.lit(9)), "ACGT", "ACNN"),
        (lambda c: sq.trim_region(c, F.lit(1), F.lit(3), F.lit(True)), "ACGT", "CG"),
        (lambda c: sq.codon_usage(c), "ATGATGNNN", {"ATG": 1.0}),
        (lambda c: sq.track_span(c, 3), "ACGTTTACGT", 4),
        (lambda c: sq.cigar_identity(c, F.lit(2)), "5M1I4M", 70.0),
        (sq.cigar_reference_length, "3S5M2D1N2I", 8),
    ],
)
def test_sequence_functions(spark, call, seq, want):
    got = one(spark, call(F.col("s").cast("string")), s=seq)
    assert got == (pytest.approx(want) if isinstance(want, float) else want)


def test_hamming(spark):
    assert one(spark, sq.hamming(F.lit("abc"), F.lit("abd"))) == 1
    assert one(spark, sq.hamming(F.lit("abc"), F.lit("ab"))) is None
    assert one(spark, sq.terminal_identity(F.lit("AAAT"), F.lit("AAAA"), 4)) == 0.75


def test_genetic_codes():
    for code in sq.DIFFERENCES:
        assert len(sq.translation_table(code)) == 64
    with pytest.raises(ValueError):
        sq.translation_table(7)


def test_filter_language(spark):
    df = spark.createDataFrame([(1, 0, 5), (0, 1, 0), (1, 1, 9)], "a int, b int, c int")
    assert df.where(filters.parse_filter("[a == 1 | b == 1 & c > 4]")).count() == 2
    with pytest.raises(ValueError):
        filters.parse_filter("[a === 1]")
    with pytest.raises(ValueError):
        filters.parse_filter("[a == x]")


def test_schemas(spark):
    df = spark.sql("select 'q' as query, 5 as qstart, 'x' as start, named_struct('u', 1, 'v', named_struct('w', 2)) as s, array(1, 2) as l")
    assert "sequence_id" in filters.normalize_names(df).columns and "qstart" in filters.normalize_names(df).columns
    assert filters.flatten_structs(df).columns == ["query", "qstart", "start", "s:u", "s:v:w", "l"]
    assert filters.nested_to_text(df.select("l")).first()["l"] == "1,2"
    with pytest.raises(ValueError):
        filters.flatten_structs(spark.sql("select 1 as `s:u`, named_struct('u', 1) as s"))
    assert filters.stack_like(spark.sql("select 1 as a"), spark.sql("select 'x' as a")).collect()[1]["a"] is None


def test_deduplication_keeps_the_first(spark):
    df = spark.createDataFrame([(3, "ACG"), (1, "CGT"), (2, "acg"), (4, None), (5, None)], "id int, s string")
    ids = lambda key: sorted(r.id for r in tables.deduplicate(df, key, ["id"]).collect())
    assert ids(F.col("s")) == [1, 2, 3, 4]
    assert ids(tables.dedup_key("seq", "id", "s", ignore_case=True)) == [1, 2, 4]
    assert ids(tables.dedup_key("seq", "id", "s", revcomp=True)) == [1, 4]


def test_samples(spark):
    df = spark.range(100).select("id", F.concat(F.lit("r"), "id", F.lit("/1")).alias("header"))
    mates = spark.range(100).select("id", F.concat(F.lit("r"), "id", F.lit("/2")).alias("header"))
    assert tables.first_reads(df, "id", 7).count() == 6
    a, b = tables.paired_sample(df, mates, "header", n=10)
    assert {r.id for r in a.collect()} == {r.id for r in b.collect()}
    assert tables.fastq_layout(df.union(mates)).first()["layout"] == "interleaved"
    assert tables.fastq_layout(df).first()["layout"] == "paired_R1"


def brute_components(pairs):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)], [(random.Random(3).randrange(60), k) for k in range(60)]])
def test_components(spark, pairs):
    got = connected_components(spark.createDataFrame(pairs, "src long, dst long"))
    assert {r.id: r.component for r in got.collect()} == brute_components(pairs)


def test_centroids(spark):
    nodes = spark.createDataFrame([("a", 9), ("b", 8), ("c", 7), ("d", 1)], "seq_id string, length long")
    edges = spark.createDataFrame([("a", "c"), ("b", "c")], "query_id string, target_id string")
    got = {r.seq_id: r.representative_id for r in clusters.centroid_clusters(nodes, edges).collect()}
    assert got == {"a": "a", "b": "b", "c": "a", "d": "d"}


def intervals_frame(spark, rows):
    return spark.createDataFrame([(q, s, e, float(score), k) for k, (q, s, e, score) in enumerate(rows)], "q string, s long, e long, score double, id long")


def test_kept_ranges_do_not_overlap(spark):
    rng = random.Random(1)
    rows = [("x", s := rng.randrange(100), s + rng.randrange(1, 30), rng.random()) for _ in range(60)]
    df = intervals_frame(spark, rows)
    kept = intervals.one_per_range(df, "q", "s", "e", "-score", ["id"], 3).collect()
    assert all(min(a.e, b.e) - max(a.s, b.s) < 3 for a in kept for b in kept if a.id < b.id)
    split = intervals.split_ranges(df, "q", "s", "e", "-score", ["id"]).collect()
    assert all(min(a.e, b.e) <= max(a.s, b.s) for k, a in enumerate(split) for b in split[k + 1 :])
    covered = {p for _, s, e, _ in rows for p in range(s, e)}
    assert {p for r in split for p in range(r.s, r.e)} == covered
    assert intervals.covered_length(df.withColumn("e", F.col("e") - 1), ["q"], "s", "e").first()["covered"] == len(covered)


def test_consolidate_modes(spark):
    df = intervals_frame(spark, [("x", 9, 2, 1), ("x", 0, 20, 5), ("x", 15, 40, 4)])
    assert intervals.consolidate(df, "drop_contained", "q", "s", "e", ties=["id"]).count() == 2
    assert intervals.consolidate(df, "merge", "q", "s", "e", ties=["id"]).first()["e"] == 40
    with pytest.raises(ValueError):
        intervals.consolidate(df, "none", "q", "s", "e")


def test_edges(spark, tmp_path):
    lines = ["# c", "a\tb\t90.0\t50\t0\t0\t1\t50\t10\t1\t1e-5\t80\t100\t100", "a\ta\t100\t100\t0\t0\t1\t100\t1\t100\t0\t200\t100\t100", "a b 80.0 50 0 0 51 100 60 20 1e-3 70 100 100"]
    (tmp_path / "h.tsv").write_text("\n".join(lines))
    df = tabular.read_blast6(spark, str(tmp_path / "h.tsv"))
    e = hits.hsps_to_edges(df, ["qstart"]).first()
    assert (e.identity, e.query_coverage, e.num_alignments) == (85.0, 100.0, 2)


def test_correlation_fixture(spark):
    wide = spark.createDataFrame([("contig_a", 1.0, 1.0, 0.0, 0.0), ("contig_b", 1.0, 1.0, 0.0, 0.0), ("contig_c", 0.0, 0.0, 1.0, 1.0), ("contig_d", 0.2, 0.5, 0.1, 0.7)], "contig_id string, s1 double, s2 double, s3 double, s4 double")
    long_ = correlate.to_long(wide, "contig_id", ["s1", "s2", "s3", "s4"])
    assert correlate.table_type(long_).first()[0] == "abundance"
    high = correlate.correlation_pairs(long_, "spearman", 0.8).collect()
    assert [(r.contig_1, r.contig_2) for r in high] == [("contig_b", "contig_a")]
    shared = correlate.cooccurrence_pairs(long_, 0.0, 1)
    assert {(r.contig_1[-1], r.contig_2[-1]): r.shared_samples for r in shared.collect()} == {("b", "a"): 2, ("d", "a"): 2, ("d", "b"): 2, ("d", "c"): 2}
    pairs = correlate.selected_pairs(correlate.correlation_pairs(long_, "spearman", 0.8), shared)
    assert correlate.groups(pairs).first()["member_count"] == 4


def test_termini(spark):
    df = spark.createDataFrame([("a", "ACGTTTTTTTGGA"), ("b", "ACGTCCCCCCGGA"), ("c", "TTTTTTTTTTTTT")], "id string, s string")
    sig = termini.signatures(df, "id", "s", 3, 5, "plus")
    groups = {r.motif: r for r in termini.exact_groups(sig).collect()}
    assert groups["ACG"].members == ["a", "b"] and groups["ACG"].end_label == "5prime"
    assert {r.motif_min: r.motif for r in termini.extend_motif(sig.where("end_label = '5prime' and contig_id <> 'c'"), ["motif_min"]).collect()} == {"ACG": "ACGT"}
    assert termini.parse_window("25-40") == (25, 40)
    near = termini.hamming_groups(spark.createDataFrame([("a", "5prime", "AAAA"), ("b", "5prime", "AAAT"), ("c", "5prime", "CCCC")], "contig_id string, end_label string, motif_min string"), 1)
    assert [(r.motif, r.members) for r in near.collect()] == [("AAAA", ["a", "b"])]
    clip = spark.createDataFrame([(1, "ACGT", ["a", "b"]), (2, "ACG", ["c"]), (3, "TTTT", ["d"])], "group_id long, motif string, members array<string>")
    assert {r.group_id: (r.motif, r.members) for r in termini.collapse_clipped(clip, 2).collect()} == {1: ("ACGT", ["a", "b", "c"]), 3: ("TTTT", ["d"])}


def test_taxonomy(spark):
    nodes = spark.createDataFrame([(1, 1, "root", "r"), (2, 1, "g", "x"), (3, 2, "s", "y"), (4, 2, "s", "z"), (5, 1, "s", "w")], "tax_id long, parent_tax_id long, rank string, scientific_name string")
    closed = taxonomy.closure(nodes)
    assert {r.tax_id: r.lineage for r in taxonomy.lineage(nodes, closed).collect()}[3] == "r;x;y"
    avail = spark.createDataFrame([(3, True), (5, True), (4, False)], "tax_id long, available boolean")
    near = {r.tax_id: r.leaf for r in taxonomy.nearest_leaf(closed, nodes, avail).collect()}
    assert near[4] == 3 and near[3] == 5
    assert taxonomy.lowest_common_ancestor(closed, spark.createDataFrame([(1, 3), (1, 4), (2, 3), (2, 5)], "set_id long, tax_id long")).orderBy("set_id").collect()[0].lca == 2


def test_masks(spark):
    seqs = spark.createDataFrame([("a", "ACGTACGT"), ("b", "ACGT")], "id string, s string")
    ranges = spark.createDataFrame([("a", 1, 2, "+"), ("a", 1, 1, "-")], "seq_id string, start long, stop long, strand string")
    assert {r.id: r.s for r in masking.mask_by_table(seqs, "id", "s", ranges).collect()} == {"a": "NNGTACGN", "b": "ACGT"}
    risk = masking.repeat_risk(spark.createDataFrame([("d", "ACGTACGTAA" * 2 + "CCCCCCTTTTGGGG" + "ACGTACGTAA" * 2)], "id string, s string"), "id", "s", 20).first()
    assert "direct_terminal_repeat" in risk.reasons


def test_motifs(spark):
    rows = [("q", "A", 0, 10, 20.0), ("q", "B", 5, 15, 30.0), ("q", "B", 20, 30, 12.0), ("q", "C", 900, 910, 50.0), ("q", "D", 40, 50, 5.0), ("r", "A", 1, 2, 3.0)]
    df = spark.createDataFrame([(*r[:4], r[4], 0.1, "p") for r in rows], "query_name string, motif_type string, ali_from long, ali_to long, score double, evalue double, motif_profile string")
    got = motifs.combine(df).collect()
    assert [(r.query_name, r.motif_types, r.total_score) for r in got] == [("q", "C", 50.0)]
    assert motifs.summary(df).count() == 2


def test_extension(spark):
    rng = random.Random(4)
    whole = "".join(rng.choice("ACGT") for _ in range(400))
    df = spark.createDataFrame([("c", "x", whole[:250]), ("c", "y", whole[180:]), ("c", "z", "A" * 60)], "cluster_id string, contig_id string, sequence string")
    got = {r.contig_id: r for r in extend.extend_clusters(df).collect()}
    assert got["x"].extended == whole and got["y"].order == 1 and got["z"].order == -1


def test_kmer_overlap(spark):
    df = spark.createDataFrame([("a", "ACGTACGTTT"), ("b", "ACGTACGTTT"), ("c", "GGGGGGGGGG"), ("d", "AC")], "id string, s string")
    assert [(r.seq_a, r.seq_b, r.overlap) for r in kmers.kmer_overlap(df, "id", "s", 4).collect()] == [("a", "b", 1.0)]


def test_fastx_round_trip(spark, tmp_path):
    rng = random.Random(5)
    records = [(f"s{k} x", "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 300)))) for k in range(200)]
    text = "".join(f">{h}\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for h, s in records)
    (tmp_path / "a.fasta").write_text(text)
    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(text)
    want = sorted(records)
    for split in (1000, 97, 1 << 20):
        got = fastx.read_fastx(spark, str(tmp_path / "a.fasta"), split)
        assert sorted((r.header, r.sequence) for r in got.collect()) == want
    assert fastx.read_fastx(spark, str(tmp_path)).count() == 400
    fastx.write_fastx(got, str(tmp_path / "out"), single=True)
    part = next((tmp_path / "out").glob("part-*"))
    assert sorted((r.header, r.sequence) for r in fastx.read_fastx(spark, str(part)).collect()) == want
    (tmp_path / "r.fq").write_text("@a 1:N\nACGT\n+\n@III\n@b\nAC\n+b\nI@\n")
    assert [(r.header, r.quality) for r in fastx.read_fastx(spark, str(tmp_path / "r.fq")).collect()] == [("a 1:N", "@III"), ("b", "I@")]
    (tmp_path / "empty.fa").write_text("")
    assert fastx.read_fastx(spark, str(tmp_path / "empty.fa")).count() == 0


def test_readers(spark, tmp_path):
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    g = tabular.read_gff(spark, put("a.gff", "##gff-version 3\nc\tp\tCDS\t1\t9\t.\t+\t0\tID=x;Name=y z\n")).first()
    assert g.score is None and g.attribute_map == {"ID": "x", "Name": "y z"}
    s = tabular.read_sam(spark, put("a.sam", "@HD\nr\t16\tc\t5\t60\t3M2D4M\t*\t0\t0\tA\tI\nu\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")).collect()
    assert [(r.start, r.end, r.strand) for r in s] == [(5, 13, "-")]
    d = tabular.read_dot_bracket(spark, put("a.dbn", ">s1\nACGU\n(..) (-1.20)\n>s2\nAC\n..\n")).collect()
    assert {(r.sequence_id, r.structure, r.score) for r in d} == {("s1", "(..)", -1.2), ("s2", "..", -0.1)}
    t = tabular.read_taxonomy(spark, put("nodes.dmp", "1\t|\t1\t|\troot\t|\n2\t|\t1\t|\tgenus\t|\n"), put("names.dmp", "2\t|\tX\t|\t\t|\tscientific name\t|\n2\t|\tY\t|\t\t|\tsynonym\t|\n"))
    assert {r.tax_id: r.scientific_name for r in t.collect()} == {1: None, 2: "X"}
    m = tabular.read_mmseqs(spark, put("m.tsv", "a\tb\t0.95\t10\t0\t0\t1\t10\t1\t10\t0.1\t9\n")).first()
    assert m.pident == 95.0 and m.qlen is None
    assert tabular.read_fixed_width(spark, put("f.txt", "#x\nab  12\n"), [4, 2], ["a", "n"], ["string", "int"]).first()["n"] == 12
    table, samples = tabular.read_abundance(spark, put("ab.tsv", "id\ts1\ts2\nx\t1\tna\ny\t\t2\n"))
    assert samples == ["s1", "s2"] and table.where("contig_id = 'y'").first()["s1"] == 0.0
    with pytest.raises(ValueError):
        tabular.read_abundance(spark, put("bad.tsv", "id\ts1\nx\tna\n"))
    line = tabular.gff_lines(spark.sql("select 'c' sequence_id, 'p' source, 'CDS' type, 1 start, 9 end, 0.5 score, '+' strand, '.' phase, 'y' name, '' empty")).first()
    assert line.value.endswith("\tname=y")
    trna = tabular.read_trnascan(spark, put("t.txt", "Sequence tRNA\n--------\nc 1 90 20 Leu TAA 0 0 55.1\n")).first()
    assert (trna.start, trna.end, trna.strand, trna.score) == (20, 90, "-", 55.1)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int)) as ts, id % 5 as k, cast(id as double) as v from range(20)").write.parquet(str(src))
    stream = spark.readStream.schema(spark.read.parquet(str(src)).schema).parquet(str(src))
    for name, out in (("d", online.deduplicate_stream(stream, F.col("k"), "ts", "30 days")), ("w", online.windowed_stats(stream, "ts", "v"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append" if name == "d" else "complete").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("d").count() == 5
    assert spark.table("w").agg(F.sum("total")).first()[0] == 190.0
