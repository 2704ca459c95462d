"""Readers of hit, annotation, abundance and taxonomy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import cigar_reference_length
from ..operators.hits import drop_self_hits, normalize_coordinates

HSP = "query_id string, target_id string, pident double, length double, mismatch bigint, gapopen bigint, qstart bigint, qend bigint, sstart bigint, send bigint, evalue double, bitscore double, qlen bigint, slen bigint"
ANI = "query_id string, target_id string, num_alignments bigint, identity double, query_coverage double, target_coverage double"
GFF = "seqid string, source string, type string, start bigint, end bigint, score float, strand string, phase bigint, attributes string"
# The columns of the HMM domain table and of the covariance-model table.
DOMAINS = "query_full_name string, hmm_full_name string, profile_accession string, hmm_len bigint, qlen bigint, full_hmm_evalue double, full_hmm_score double, full_hmm_bias double, this_dom_score double, this_dom_bias double, hmm_from bigint, hmm_to bigint, q1 bigint, q2 bigint, env_from bigint, env_to bigint, hmm_cov double, ali_len bigint, dom_desc string"
CMSCAN = ["target_name", "target_accession", "query_name", "query_accession", "mdl", "mdl_from", "mdl_to", "seq_from", "seq_to", "strand", "trunc", "pass", "gc", "bias", "score", "evalue", "inc", "description"]


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(x.split(" ")) for x in schema.split(", ")]


def _typed(df: DataFrame, cells: Column, schema: str) -> DataFrame:
    """Cells of an array by position; missing or bad ones are null."""
    return df.select(cells.alias("_c")).select(*[F.expr(f"try_cast(get(_c, {k}) as {kind})").alias(name) for k, (name, kind) in enumerate(_fields(schema))])


def _text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).where("value <> '' and not startswith(value, '#')")


def read_blast6(spark: SparkSession, path: str) -> DataFrame:
    """12 or 14 columns between tabs, or between blanks in lines without a tab."""
    cells = F.split(F.trim("value"), F.when(F.contains("value", F.lit("\t")), "\t").otherwise(" +"))
    return normalize_coordinates(_typed(_text(spark, path), cells, HSP), ("qstart", "qend"), ("sstart", "send"))


def read_ani(spark: SparkSession, path: str) -> DataFrame:
    """qname, tname, num_alns, pid, qcov, tcov; a header line fails the cast and goes with other nulls."""
    return drop_self_hits(_typed(_text(spark, path), F.split("value", "\t"), ANI)).where("identity is not null")


def read_mmseqs(spark: SparkSession, path: str) -> DataFrame:
    """12 or 14 columns; an identity of 1 or less is a fraction and becomes percent; all have two digits."""
    df = _typed(_text(spark, path), F.split("value", "\t"), HSP).where("query_id is not null and pident is not null")
    return df.withColumn("pident", F.round(F.when(F.col("pident") <= 1, F.col("pident") * 100).otherwise(F.col("pident")), 2))


def read_fixed_width(spark: SparkSession, path: str, widths: list[int], names: list[str], kinds: list[str] | None = None, comment: str = "#") -> DataFrame:
    kinds = kinds or ["string"] * len(names)
    starts = [1 + sum(widths[:k]) for k in range(len(widths))]
    lines = spark.read.text(path).where((F.col("value") != "") & ~F.startswith("value", F.lit(comment)))
    return lines.select(*[F.expr(f"try_cast(trim(substring(value, {s}, {w})) as {t})").alias(n) for s, w, n, t in zip(starts, widths, names, kinds, strict=True)])


def read_cmscan(spark: SparkSession, path: str) -> DataFrame:
    cells = F.split(F.trim("value"), " +", 18)
    kinds = {"mdl_from": "bigint", "mdl_to": "bigint", "seq_from": "bigint", "seq_to": "bigint", "gc": "double", "bias": "double", "score": "double", "evalue": "double"}
    return _typed(_text(spark, path), cells, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in CMSCAN))


def read_domains(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.csv(paths, sep="\t", header=True, schema=DOMAINS, enforceSchema=False) if isinstance(paths, list) else spark.read.csv(paths, sep="\t", header=True, schema=DOMAINS)


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Nine columns, a dot is null, and ``attribute_map``; a sequence section after ##FASTA fails the column count."""
    lines = _text(spark, path).where(F.size(F.split("value", "\t")) >= 9)
    raw = _typed(lines, F.transform(F.split("value", "\t"), lambda c: F.nullif(c, F.lit("."))), GFF)
    pairs = F.regexp_extract_all("attributes", F.lit(r"(\w+)=([^;]+)"), F.lit(0))
    return raw.withColumn("attribute_map", F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substr(p, F.locate("=", p) + 1).alias("v")))))


def read_trnascan(spark: SparkSession, path: str) -> DataFrame:
    """Rows of nine cells whose third and fourth are numbers; begin after end is the minus strand."""
    c = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where((F.size(c) >= 9) & F.get(c, F.lit(2)).rlike(r"^\d+$") & F.get(c, F.lit(3)).rlike(r"^\d+$"))
    b, e = F.get(c, F.lit(2)).cast("long"), F.get(c, F.lit(3)).cast("long")
    return rows.select(F.get(c, F.lit(0)).alias("sequence_id"), F.lit("tRNA").alias("type"), F.least(b, e).alias("start"), F.greatest(b, e).alias("end"), F.expr("try_cast(get(split(trim(value), '\\\\s+'), 8) as double)").alias("score"), F.when(b > e, "-").otherwise("+").alias("strand"), F.get(c, F.lit(4)).alias("tRNA_type"), F.get(c, F.lit(5)).alias("anticodon"))


def read_dot_bracket(spark: SparkSession, path: str, default: float = -0.1) -> DataFrame:
    """Records of name, sequence and structure with ``(energy)``."""
    rec = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    lines = F.split("value", r"\r?\n")
    energy = F.expr(r"try_cast(nullif(regexp_extract(get(l, 2), '\\(\\s*(-?[0-9.]+)\\s*\\)\\s*$', 1), '') as double)")
    return rec.select(lines.alias("l")).select(F.trim(F.get("l", F.lit(0))).alias("sequence_id"), F.trim(F.get("l", F.lit(1))).alias("sequence"), F.substring_index(F.trim(F.get("l", F.lit(2))), " ", 1).alias("structure"), F.coalesce(energy, F.lit(default)).alias("score"))


def read_delimited(spark: SparkSession, path: str, renames: dict[str, str] | None = None) -> DataFrame:
    """A table with a header; commas for .csv, tabs else."""
    return spark.read.csv(path, sep="," if path.endswith((".csv", ".csv.gz")) else "\t", header=True, inferSchema=True).withColumnsRenamed(renames or {})


def read_abundance(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Wide table of doubles and its sample names; a sample without any number is an error."""
    df = spark.read.csv(path, sep="," if path.endswith((".csv", ".csv.gz")) else "\t", header=True)
    samples = df.columns[1:]
    cast = df.select(F.col(df.columns[0]).alias("contig_id"), *[F.expr(f"try_cast(`{s}` as double)").alias(s) for s in samples])
    counts = cast.agg(*[F.count(f"`{s}`").alias(s) for s in samples]).first()
    empty = [s for s in samples if not counts[s]]
    if empty:
        raise ValueError(f"samples without values: {empty}")
    return cast.na.fill(0.0), samples


def read_with_path(spark: SparkSession, glob: str, sep: str, names: list[str]) -> DataFrame:
    """All files of a pattern in one frame, with the file of each row."""
    raw = spark.read.text(glob).select("value", F.col("_metadata.file_path").alias("path"))
    cells = F.split("value", f"[{sep}]")
    return raw.select(*[F.get(cells, F.lit(k)).alias(n) for k, n in enumerate(names)], "path")


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """rname, start, end (1-based, inclusive) and strand of aligned records."""
    c = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("@")) & (F.size(c) >= 6)).select(F.get(c, F.lit(0)).alias("qname"), F.get(c, F.lit(1)).cast("int").alias("flag"), F.get(c, F.lit(2)).alias("rname"), F.get(c, F.lit(3)).cast("long").alias("start"), F.get(c, F.lit(5)).alias("cigar")).where("rname <> '*' and cigar <> '*'")
    return rows.select("qname", "rname", "start", (F.col("start") + cigar_reference_length(F.col("cigar")) - 1).alias("end"), F.when(F.col("flag").bitwiseAND(F.lit(16)) != 0, "-").otherwise("+").alias("strand"), "cigar")


def _dump(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t").alias("c"))


def read_taxonomy(spark: SparkSession, nodes: str, names: str) -> DataFrame:
    """tax_id, parent_tax_id, rank and scientific_name from two dumps."""
    n = _dump(spark, nodes).select(F.get("c", F.lit(0)).cast("long").alias("tax_id"), F.get("c", F.lit(1)).cast("long").alias("parent_tax_id"), F.get("c", F.lit(2)).alias("rank"))
    m = _dump(spark, names).where(F.get("c", F.lit(3)) == "scientific name").select(F.get("c", F.lit(0)).cast("long").alias("tax_id"), F.get("c", F.lit(1)).alias("scientific_name"))
    return n.join(m, "tax_id", "left")


def read_assembly_summary(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return _text(spark, path).select(F.split("value", "\t").alias("c")).select(*[F.get("c", F.lit(k)).alias(n) for k, n in enumerate(names)])


def read_contaminant_stats(spark: SparkSession, path: str) -> DataFrame:
    """tax_id (text before the first @), name, reads of a read-filter report; headers fail the cast."""
    c = F.split("value", "\t")
    return spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(F.expr("try_cast(split_part(value, '@', 1) as bigint)").alias("tax_id"), F.get(c, F.lit(0)).alias("name"), F.expr("try_cast(get(split(value, '\\t'), 1) as bigint)").alias("reads")).where("tax_id is not null")


def read_motif_details(spark: SparkSession, path: str) -> DataFrame:
    """profile, motif_type and original_name from one JSON object of objects."""
    raw = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string, struct<motif_type: string, original_name: string>>")
    return raw.select(F.explode(parsed).alias("profile", "d")).select("profile", "d.motif_type", "d.original_name")


# ---- writers --------------------------------------------------------------


def gff_lines(df: DataFrame, core: tuple[str, ...] = ("sequence_id", "source", "type", "start", "end", "score", "strand", "phase")) -> DataFrame:
    """GFF3 lines; all other columns that are not empty become attributes."""
    others = [c for c in df.columns if c not in core]
    pairs = F.array_compact(F.array(*[F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", F.concat(F.lit(f"{c}="), F.col(c).cast("string"))) for c in others])) if others else F.array().cast("array<string>")
    text = F.when(F.size(pairs) > 0, F.array_join(pairs, ";")).otherwise(".")
    return df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in core], text).alias("value"))


def write_gff(df: DataFrame, path: str, sequences: DataFrame | None = None) -> None:
    """One file: header, features, then an optional FASTA section. Sections keep their order by a sort."""
    spark = df.sparkSession
    part = lambda f, k: f.select(F.lit(k).alias("k"), "value")
    rows = part(spark.sql("select '##gff-version 3' as value"), 0).union(part(gff_lines(df), 1))
    if sequences is not None:
        from .fastx import to_fasta

        rows = rows.union(part(spark.sql("select '##FASTA' as value"), 2)).union(part(to_fasta(sequences, "header", "sequence"), 3))
    rows.coalesce(1).sortWithinPartitions("k", "value").select("value").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, kind: str) -> None:
    """tsv, csv, parquet or jsonl; nested columns become text in the first two."""
    from ..operators.filters import nested_to_text

    w = (nested_to_text(df) if kind in ("tsv", "csv") else df).write.mode("overwrite")
    {"tsv": lambda: w.csv(path, sep="\t", header=True), "csv": lambda: w.csv(path, header=True), "parquet": lambda: w.parquet(path), "jsonl": lambda: w.json(path)}[kind]()
