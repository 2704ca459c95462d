"""Readers, writers and the operators that work on their tables, over files written from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions import sequence as sq
from ..operators import candidates, clusters, correlate, filters, hits, kmers, masking, motifs, tables, taxonomy, termini
from ..session import read_table, shared_dir
from ..sources import fastx, tabular

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _file(df: DataFrame, *columns: Column, sep: str = "\t", head: str | None = None) -> str:
    """Lines of the columns in the shared folder; ``head`` goes before them."""
    path = f"{shared_dir(df.sparkSession)}/text-{uuid.uuid4().hex}"
    lines = df.select(F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]).alias("value"))
    if head is not None:
        lines = df.sparkSession.createDataFrame([(head,)], "value string").union(lines)
    lines.write.text(path)
    return path


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _parts(spark, d):
    return read_table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.md5("p_name").alias("s"), "p_name", "p_type", "p_size", "p_partkey")


# ---- sequence files -------------------------------------------------------


@query("SELECT 'p' || p_partkey || ' ' || p_name AS header, md5(p_name) AS sequence FROM part")
def scan_fasta(spark, d):
    folder = _folder(spark)
    fastx.write_fastx(_parts(spark, d).select(F.concat(F.lit("p"), "id", F.lit(" "), "p_name").alias("header"), F.col("s").alias("sequence")), folder)
    return fastx.read_fastx(spark, folder, split_bytes=2000).select("header", "sequence")


@query("SELECT 'r' || p_partkey AS header, md5(p_name) AS sequence, md5(p_type) AS quality FROM part")
def scan_fastq(spark, d):
    folder = _folder(spark)
    reads = _parts(spark, d).select(F.concat(F.lit("r"), "id").alias("header"), F.col("s").alias("sequence"), F.md5("p_type").alias("quality"))
    fastx.write_fastx(reads, folder, quality="quality", kind="fastq")
    return fastx.read_fastx(spark, folder)


@query("SELECT cast(p_partkey AS VARCHAR) AS contig_id, md5(p_name) || p_type AS sequence, cast(strlen(md5(p_name) || p_type) AS BIGINT) AS seq_length FROM part")
def contig_loader(spark, d):
    folder = _folder(spark)
    fastx.write_fastx(_parts(spark, d).select(F.col("id").alias("header"), F.concat("s", "p_type").alias("sequence")), folder, single=True)
    return fastx.load_contigs(spark, folder)


@query("SELECT '>' || p_partkey || chr(10) || p_type AS fasta, '@' || p_partkey || chr(10) || p_type || chr(10) || '+' || chr(10) || p_name AS fastq FROM part")
def fasta_fastq_lines(spark, d):
    p = _parts(spark, d)
    q = fastx.to_fastq(p, "id", "p_type", "p_name").select(F.col("value").alias("fastq"))
    return fastx.to_fasta(p, "id", "p_type").select(F.col("value").alias("fasta"), F.split_part(F.substr("value", F.lit(2)), F.lit("\n"), F.lit(1)).alias("k")).join(q.withColumn("k", F.split_part(F.substr("fastq", F.lit(2)), F.lit("\n"), F.lit(1))), "k").drop("k")


@query("SELECT p_partkey || '_' || (p_size % 5 + 1) || '-' || (p_size % 5 + 6) AS header, translate(substr(p_type, p_size % 5 + 1, 6), '-.', '') AS sequence FROM part WHERE translate(substr(p_type, p_size % 5 + 1, 6), '-.', '') <> ''")
def matched_regions(spark, d):
    h = _parts(spark, d).withColumns({"a": (F.col("p_size") % 5 + 1).cast("long"), "e": (F.col("p_size") % 5 + 6).cast("long")})
    return fastx.matched_regions(h, "id", "p_type", "a", "e")


@query("SELECT 10 AS first, 10 AS second, 'interleaved' AS layout FROM region LIMIT 1")
def fastq_layout(spark, d):
    reads = spark.range(10).select(F.explode(F.array(F.concat(F.lit("read"), F.col("id"), F.lit("/1")), F.concat(F.lit("read"), F.col("id"), F.lit("/2")))).alias("header"))
    return tables.fastq_layout(reads).select(F.col("first").cast("int").alias("first"), F.col("second").cast("int").alias("second"), "layout")


# ---- hit, annotation and taxonomy files -----------------------------------

_L = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _lines(spark, d):
    return read_table(spark, d, "lineitem")


@query("SELECT l_orderkey || '-' || l_linenumber AS query_id, cast(l_partkey AS VARCHAR) AS target_id, 100 - l_linenumber AS pident, cast(l_quantity AS DOUBLE) AS length, l_suppkey AS mismatch, least(l_partkey, l_suppkey) AS qstart, greatest(l_partkey, l_suppkey) AS qend, cast(NULL AS BIGINT) AS qlen FROM lineitem")
def read_blast6(spark, d):
    c = F.col
    path = _file(_lines(spark, d), F.concat_ws("-", "l_orderkey", "l_linenumber"), c("l_partkey"), 100 - c("l_linenumber"), c("l_quantity"), c("l_suppkey"), F.lit(0), c("l_partkey"), c("l_suppkey"), F.lit(1), F.lit(9), F.lit("1e-5"), F.lit(50), head="# hits")
    return tabular.read_blast6(spark, path).select("query_id", "target_id", F.col("pident").cast("int").alias("pident"), "length", "mismatch", "qstart", "qend", "qlen")


@query("SELECT cast(l_orderkey AS VARCHAR) AS query_id, cast(l_partkey AS VARCHAR) AS target_id, cast(l_linenumber AS BIGINT) AS num_alignments, cast(l_quantity AS DOUBLE) AS identity FROM lineitem WHERE l_orderkey <> l_partkey")
def read_ani(spark, d):
    c = F.col
    path = _file(_lines(spark, d), c("l_orderkey"), c("l_partkey"), c("l_linenumber"), c("l_quantity"), F.lit(50), F.lit(60), head="qname\ttname\tnum_alns\tpid\tqcov\ttcov")
    return tabular.read_ani(spark, path).select("query_id", "target_id", "num_alignments", "identity")


@query("SELECT cast(l_orderkey AS VARCHAR) AS query_id, cast(l_partkey AS VARCHAR) AS target_id, cast(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE round(l_quantity / 100, 2) * 100 END AS BIGINT) AS pident FROM lineitem")
def read_mmseqs(spark, d):
    c = F.col
    identity = F.when(c("l_linenumber") == 1, c("l_quantity")).otherwise(F.round(c("l_quantity") / 100, 2))
    path = _file(_lines(spark, d).withColumn("i", F.when((c("l_linenumber") == 1) & (c("l_quantity") == 1), F.lit(0.01)).otherwise(identity)), c("l_orderkey"), c("l_partkey"), c("i"), *[F.lit(k) for k in range(9)])
    return tabular.read_mmseqs(spark, path).select("query_id", "target_id", F.round("pident").cast("long").alias("pident"))


@query("SELECT cast(p_partkey AS VARCHAR) AS id, p_type AS kind, cast(p_size AS BIGINT) AS size FROM part")
def read_fixed_width(spark, d):
    p = _parts(spark, d)
    path = _file(p, F.rpad("id", 12, " "), F.rpad("p_type", 30, " "), F.lpad(F.col("p_size").cast("string"), 6, " "), sep="", head="# table")
    return tabular.read_fixed_width(spark, path, [12, 30, 6], ["id", "kind", "size"], ["string", "string", "bigint"])


@query("SELECT 'RF' || p_partkey AS target_name, cast(p_size AS BIGINT) AS seq_from, cast(p_size + 10 AS BIGINT) AS seq_to, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand, p_name || ' gene' AS description FROM part")
def read_cmscan(spark, d):
    c = F.col
    head = [F.concat(F.lit("RF"), "id"), F.lit("acc"), F.lit("q"), F.lit("-"), F.lit("cm"), F.lit(1), F.lit(90), c("p_size"), c("p_size") + 10, F.when(c("p_size") % 2 == 0, "+").otherwise("-"), F.lit("no"), F.lit(1), F.lit(0.5), F.lit(0.0), F.lit(33.1), F.lit("1e-9"), F.lit("!")]
    path = _file(_parts(spark, d), *head, F.concat("p_name", F.lit(" gene")), sep="  ", head="#target name")
    return tabular.read_cmscan(spark, path).select("target_name", "seq_from", "seq_to", "strand", "description")


@query("SELECT cast(p_partkey AS VARCHAR) AS seqid, cast(NULL AS VARCHAR) AS source, 'CDS' AS type, cast(p_size AS BIGINT) AS \"start\", cast(p_size + 5 AS BIGINT) AS \"end\", p_type AS product, 'g' || p_partkey AS gene FROM part")
def read_gff(spark, d):
    c = F.col
    rows = _parts(spark, d).select(c("id").alias("sequence_id"), F.lit(".").alias("source"), F.lit("CDS").alias("type"), c("p_size").alias("start"), (c("p_size") + 5).alias("end"), F.lit("0.5").alias("score"), F.lit("+").alias("strand"), F.lit("0").alias("phase"), c("p_type").alias("product"), F.concat(F.lit("g"), "id").alias("gene"))
    folder = _folder(spark)
    tabular.write_gff(rows, folder)
    return tabular.read_gff(spark, folder).select("seqid", "source", "type", "start", "end", c("attribute_map")["product"].alias("product"), c("attribute_map")["gene"].alias("gene"))


@query("SELECT cast(p_partkey AS VARCHAR) AS sequence_id, cast(least(p_size, 25) AS BIGINT) AS \"start\", cast(greatest(p_size, 25) AS BIGINT) AS \"end\", CASE WHEN p_size > 25 THEN '-' ELSE '+' END AS strand, 'Ala' AS tRNA_type, 'TGC' AS anticodon FROM part")
def read_trnascan(spark, d):
    c = F.col
    path = _file(_parts(spark, d), c("id"), F.lit(1), c("p_size"), F.lit(25), F.lit("Ala"), F.lit("TGC"), F.lit(0), F.lit(0), F.lit("61.5"), head="Sequence\ttRNA\tBegin\tEnd\tType\tCodon\tb\te\tScore")
    return tabular.read_trnascan(spark, path).select("sequence_id", "start", "end", "strand", "tRNA_type", "anticodon")


@query("SELECT cast(p_partkey AS VARCHAR) AS sequence_id, md5(p_name) AS sequence, '((..))' AS structure, -cast(p_size AS DOUBLE) AS score FROM part")
def read_dot_bracket(spark, d):
    c = F.col
    path = _file(_parts(spark, d), F.concat(F.lit(">"), "id", F.lit("\n"), "s", F.lit("\n((..)) (-"), c("p_size"), F.lit(".00)")))
    return tabular.read_dot_bracket(spark, path)


@query("SELECT cast(p_partkey AS VARCHAR) AS contig_id, cast(p_size AS DOUBLE) AS a, cast(0 AS DOUBLE) AS b, cast(p_partkey % 7 AS DOUBLE) AS c FROM part")
def read_abundance(spark, d):
    c = F.col
    path = _file(_parts(spark, d).coalesce(1), c("id"), c("p_size"), F.when(c("p_partkey") % 2 == 0, "0").otherwise("NA"), c("p_partkey") % 7, head=None)
    lines = spark.read.text(path)
    whole = f"{_folder(spark)}"
    spark.createDataFrame([("contig\ta\tb\tc",)], "value string").union(lines).coalesce(1).write.text(whole)
    return tabular.read_abundance(spark, whole)[0]


@query("SELECT p_type AS kind, cast(count(*) AS BIGINT) AS n, count(DISTINCT p_size % 3) AS files FROM part GROUP BY p_type")
def scan_with_path(spark, d):
    folder = _folder(spark)
    _parts(spark, d).select(F.concat_ws("|", "id", "p_type").alias("value"), (F.col("p_size") % 3).alias("k")).write.partitionBy("k").text(folder)
    rows = tabular.read_with_path(spark, f"{folder}/*", "|", ["id", "kind"])
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.regexp_extract("path", r"k=(\d)", 1)).alias("files"))


@query("SELECT cast(100 + n_nationkey AS BIGINT) AS tax_id, cast(1 + n_regionkey AS BIGINT) AS parent_tax_id, 'nation' AS rank, n_name AS scientific_name FROM nation")
def read_taxonomy_dumps(spark, d):
    n = read_table(spark, d, "nation")
    nodes = _file(n, F.col("n_nationkey") + 100, F.col("n_regionkey") + 1, F.concat(F.lit("nation"), F.lit("\t|")), sep="\t|\t")
    known = n.select(F.explode(F.array(F.struct("n_nationkey", "n_name", F.lit("scientific name").alias("k")), F.struct("n_nationkey", F.lower("n_name").alias("n_name"), F.lit("synonym").alias("k")))).alias("x")).select("x.*")
    named = _file(known, F.col("n_nationkey") + 100, F.col("n_name"), F.lit(""), F.concat("k", F.lit("\t|")), sep="\t|\t")
    return tabular.read_taxonomy(spark, nodes, named)


@query("SELECT 'GCF_' || n_nationkey AS accession, n_name AS organism, 'ftp' AS path FROM nation")
def read_assembly_summary(spark, d):
    path = _file(read_table(spark, d, "nation"), F.concat(F.lit("GCF_"), "n_nationkey"), F.col("n_name"), F.lit("ftp"), head="#accession\torganism")
    return tabular.read_assembly_summary(spark, path, ["accession", "organism", "path"])


@query("SELECT cast(p_partkey AS BIGINT) AS tax_id, p_partkey || '@x@' || p_type AS name, cast(p_size AS BIGINT) AS reads FROM part")
def read_contaminant_stats(spark, d):
    path = _file(_parts(spark, d), F.concat("id", F.lit("@x@"), "p_type"), F.col("p_size"), head="#Name\tReads")
    return tabular.read_contaminant_stats(spark, path)


_SAM = "SELECT l_orderkey || '.' || l_linenumber AS qname, cast(l_suppkey AS VARCHAR) AS rname, cast(l_partkey AS BIGINT) AS \"start\", cast(l_partkey + cast(l_quantity AS BIGINT) + 2 AS BIGINT) AS \"end\", CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand FROM lineitem"


def _sam(spark, d):
    c = F.col
    cigar = F.concat(F.lit("4S"), c("l_quantity").cast("long"), F.lit("M2I3D"))
    path = _file(_lines(spark, d), F.concat_ws(".", "l_orderkey", "l_linenumber"), F.when(c("l_linenumber") % 2 == 0, 16).otherwise(0), c("l_suppkey"), c("l_partkey"), F.lit(60), cigar, F.lit("*"), head="@HD\tVN:1.6")
    return tabular.read_sam(spark, path)


@query(_SAM)
def read_sam(spark, d):
    return _sam(spark, d).select("qname", "rname", "start", "end", "strand")


@query(f"""WITH m AS (SELECT DISTINCT cast(rname AS BIGINT) AS k, unnest(range(greatest("start" % 40, 1), greatest("start" % 40, 1) + 4)) AS i FROM ({_SAM})), c AS (SELECT s_suppkey, md5(s_name) AS s, unnest(range(1, 33)) AS i FROM supplier)
SELECT s_suppkey AS id, string_agg(CASE WHEN m.i IS NULL THEN substr(s, c.i, 1) ELSE 'N' END, '' ORDER BY c.i) AS masked FROM c LEFT JOIN m ON m.k = s_suppkey AND m.i = c.i GROUP BY s_suppkey""")
def mask_by_sam(spark, d):
    ranges = _sam(spark, d).select("rname", F.greatest(F.col("start") % 40, F.lit(1)).alias("start")).withColumn("end", F.col("start") + 3)
    s = read_table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.md5("s_name").alias("s"))
    return masking.mask_by_alignments(s, "id", "s", ranges).select(F.col("id").cast("long").alias("id"), F.col("s").alias("masked"))


@query("SELECT p_type AS profile, 'ABCD'[1 + cast(min(p_size) % 4 AS INTEGER)] AS motif_type, min(p_name) AS original_name FROM part GROUP BY p_type")
def read_motif_details(spark, d):
    kind = F.substr(F.lit("ABCD"), (F.min("p_size") % 4 + 1).cast("int"), F.lit(1))
    rows = _parts(spark, d).groupBy("p_type").agg(F.struct(kind.alias("motif_type"), F.min("p_name").alias("original_name")).alias("v"))
    folder = _folder(spark)
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_type", "v")))).alias("value")).coalesce(1).write.text(folder)
    return tabular.read_motif_details(spark, folder)


@query("SELECT n_nationkey AS tax_id, n_name AS name, cast(n_regionkey AS INTEGER) AS reads FROM nation")
def read_delimited(spark, d):
    folder = _folder(spark)
    tabular.write_table(read_table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), folder, "tsv")
    return tabular.read_delimited(spark, folder, {"n_nationkey": "tax_id", "n_name": "name", "n_regionkey": "reads"})


@query("SELECT user_id, count(*) AS n, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM events GROUP BY user_id")
def write_nested_table(spark, d):
    folder = _folder(spark)
    nested = read_table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("event_id")).alias("ids"))
    tabular.write_table(nested, folder, "jsonl")
    tabular.write_table(spark.read.schema(nested.schema).json(folder), f"{folder}-csv", "csv")
    return spark.read.csv(f"{folder}-csv", header=True, schema="user_id long, n long, ids string")


@query("SELECT count(*) AS total_sequences, max(strlen(text)) AS max_length FROM documents")
def markdown_report(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("h"), "text")
    text = tables.markdown_report(tables.fastx_stats(tables.fastx_calc(docs, "h", "text")).select("total_sequences", "max_length"))
    return spark.createDataFrame([tuple(int(line.split("|")[2]) for line in text.splitlines()[2:])], "total_sequences long, max_length long")


# ---- filters and schemas --------------------------------------------------


@query("SELECT DISTINCT p_partkey AS query_id, p_size AS target_id FROM part WHERE (p_partkey, p_size) IN (SELECT s_suppkey, cast(s_nationkey AS BIGINT) FROM supplier) OR (p_size, p_partkey) IN (SELECT s_suppkey, cast(s_nationkey AS BIGINT) FROM supplier)")
def prefilter_pairs(spark, d):
    edges = read_table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), F.col("p_size").alias("target_id")).distinct()
    pairs = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("seq_a"), F.col("s_nationkey").cast("long").alias("seq_b"))
    return hits.prefilter_pairs(edges, pairs)


@query("SELECT cast(o_custkey AS VARCHAR) AS seqid, o_orderkey AS \"start\", '1' AS \"end\", 'rp' AS source, 'feature' AS type, '0' AS score, '+' AS strand, '.' AS phase FROM orders")
def gff_defaults(spark, d):
    o = read_table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("seqid"), F.col("o_orderkey").alias("start"))
    return filters.with_gff_columns(o)


@query("SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS v FROM orders UNION ALL SELECT event_id, event_type, NULL FROM events")
def stack_like(spark, d):
    first = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("v"))
    second = read_table(spark, d, "events").select(F.col("event_type").alias("s"), F.lit("none").alias("v"), F.col("event_id").cast("string").alias("k"))
    return filters.stack_like(first, second)


@query("SELECT p_partkey, cast(p_partkey AS VARCHAR) || 'x' AS source_seq_id, cast(p_size % 3 + 1 AS VARCHAR) AS frame_id, cast(p_size AS VARCHAR) AS orf_id FROM part")
def provenance(spark, d):
    q = F.concat("id", F.lit("x_frame="), (F.col("p_size") % 3 + 1).cast("string"), F.lit("_ORF."), F.col("p_size").cast("string"))
    return _parts(spark, d).select("p_partkey", *[c.alias(n) for n, c in filters.provenance(q).items()])


@query("SELECT p_partkey AS ali_from, p_partkey + p_size AS ali_to, p_partkey AS s, p_partkey + p_size AS e FROM part")
def coordinate_columns(spark, d):
    p = read_table(spark, d, "part").select(F.col("p_partkey").alias("ali_from"), (F.col("p_partkey") + F.col("p_size")).alias("ali_to"))
    s, e = filters.coordinate_columns(p.columns)
    return p.select("*", F.col(s).alias("s"), F.col(e).alias("e"))


@query("WITH t AS (SELECT p_type AS k, min(p_brand) AS b FROM part WHERE p_size > 40 GROUP BY 1) SELECT p_partkey, b AS motif_type FROM part LEFT JOIN t ON k = p_type")
def motif_types(spark, d):
    p = read_table(spark, d, "part")
    details = p.where("p_size > 40").groupBy(F.col("p_type").alias("profile")).agg(F.min("p_brand").alias("motif_type"))
    return motifs.type_of_motif(p.select("p_partkey", F.col("p_type").alias("motif_profile")), details).select("p_partkey", "motif_type")


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 25 THEN p_type END, p_brand) AS accession, regexp_replace(p_brand, '#[0-9]+$', '') AS clean FROM part")
def accession_choice(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") > 25, F.col("p_type")).alias("accession"), F.col("p_brand").alias("target_name"))
    return p.select("p_partkey", filters.pick_first(p, filters.ACCESSIONS).alias("accession"), F.regexp_replace("p_brand", "#[0-9]+$", "").alias("clean"))


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END, c_acctbal) AS v FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def fill_from(spark, d):
    base = read_table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("v"))
    other = read_table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return filters.fill_from(base, other, ["k"], ["v"]).select("o_orderkey", "v")


@query("SELECT page_id, split_part(url, '/', 1) AS taxid, nullif(split_part(url, '/', 3), '') AS kind, regexp_matches(url, '^[SED]R[RXSP][0-9]{6,}$') AS run, 12 AS c, cast(page_id AS BIGINT) AS i FROM pages")
def header_parts(spark, d):
    p = read_table(spark, d, "pages")
    at = names.header_fields(F.replace("url", F.lit("/"), F.lit("@")))
    tag = names.tagged_numbers(F.concat(F.lit("x c_12;i_"), F.col("page_id").cast("string")))
    return p.select("page_id", at["taxid"].alias("taxid"), F.nullif(at["type"], F.lit("")).alias("kind"), names.is_run_accession(F.col("url")).alias("run"), tag["c"].cast("int").alias("c"), tag["i"].alias("i"))


@query("SELECT p_partkey, p_brand || '> -' || p_size || '- <' || p_type AS label, len(regexp_extract_all(p_type, '[GC]')) / length(p_type) AS gc FROM part")
def labels_and_upper_gc(spark, d):
    label = names.chain_label(F.array("p_brand", "p_type"), F.array(F.lit("+"), F.lit("-")), F.array(F.col("p_size").cast("string"), F.lit(None).cast("string")))
    return read_table(spark, d, "part").select("p_partkey", label.alias("label"), sq.gc_upper(F.col("p_type")).alias("gc"))


# ---- samples, ranks, pairs ------------------------------------------------


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def first_reads(spark, d):
    return tables.first_reads(read_table(spark, d, "documents").select("doc_id"), "doc_id", 51)


@query("SELECT 'r' || doc_id || '/2' AS header FROM documents ORDER BY md5('r' || doc_id || '/1:42'), doc_id LIMIT 100")
def paired_sample(spark, d):
    mate = lambda k: read_table(spark, d, "documents").select(F.concat(F.lit("r"), F.col("doc_id").cast("string"), F.lit(f"/{k}")).alias("header"))
    return tables.paired_sample(mate(1), mate(2), "header", n=100)[1]


@query("""WITH m AS (SELECT o_custkey AS q, ['self', 'ancestor', 'relative'][1 + o_orderkey % 3] AS rel, o_orderkey AS r FROM orders WHERE o_orderkey % 3 < 2),
z AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY CASE rel WHEN 'self' THEN 0 ELSE 1 END, cast(r AS VARCHAR)) AS k FROM m)
SELECT q AS query_tax_id, rel AS relationship, cast(r AS VARCHAR) AS reference_name FROM z WHERE k = 1 AND q IN (SELECT DISTINCT q FROM m ORDER BY q LIMIT 40)""")
def genome_choice(spark, d):
    kinds = F.array(F.lit("self"), F.lit("ancestor"), F.lit("relative"))
    m = read_table(spark, d, "orders").select(F.col("o_custkey").alias("query_tax_id"), F.element_at(kinds, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("relationship"), F.col("o_orderkey").cast("string").alias("reference_name"), F.lit("ftp").alias("ftp_path"))
    return taxonomy.select_genomes(m, ["self", "ancestor"], 40).drop("ftp_path")


@query("SELECT c_nationkey AS query_id, c_mktsegment AS target_id, round(avg(c_acctbal), 4) AS identity, max(c_acctbal) AS query_coverage, max(c_custkey) AS target_coverage, count(*) AS num_alignments FROM customer GROUP BY ALL")
def ani_dedupe(spark, d):
    e = read_table(spark, d, "customer").select(F.col("c_nationkey").alias("query_id"), F.col("c_mktsegment").alias("target_id"), F.col("c_acctbal").alias("identity"), F.col("c_acctbal").alias("query_coverage"), F.col("c_custkey").alias("target_coverage"))
    return hits.dedupe_ani(e).withColumn("identity", F.round("identity", 4))


@query("SELECT a AS contig_1, b AS contig_2, max(c) AS correlation, max(s) AS shared_fraction FROM (SELECT l_orderkey AS a, l_linenumber AS b, l_discount AS c, NULL AS s FROM lineitem UNION ALL SELECT o_orderkey, cast(o_custkey % 8 AS INTEGER), NULL, o_totalprice FROM orders) GROUP BY ALL")
def pairs_of_both_kinds(spark, d):
    c = _lines(spark, d).select(F.col("l_orderkey").alias("contig_1"), F.col("l_linenumber").alias("contig_2"), F.col("l_discount").alias("correlation"))
    s = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("contig_1"), (F.col("o_custkey") % 8).cast("int").alias("contig_2"), F.col("o_totalprice").alias("shared_fraction"))
    return correlate.selected_pairs(c, s)


@query("SELECT p_partkey AS seq_id, cast(p_partkey AS VARCHAR) AS s FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS r FROM part) WHERE r = 1")
def representative_sequences(spark, d):
    p = read_table(spark, d, "part")
    first = p.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("m"))
    assigned = p.join(first, ["p_brand", "p_size"]).select(F.col("p_partkey").alias("seq_id"), (F.col("p_partkey") == F.col("m")).alias("is_representative"))
    return clusters.representatives(p.select(F.col("p_partkey").alias("seq_id"), F.col("p_partkey").cast("string").alias("s")), assigned, "seq_id")


@query("SELECT s_suppkey, s_nationkey % 3 = n % 3 AS shares_5prime, s_nationkey % 2 = n % 2 AS shares_3prime, s_nationkey % 3 = n % 3 AND s_nationkey % 2 = n % 2 AS shares_both_ends, s_nationkey % 3 = n % 2 OR s_nationkey % 2 = n % 3 AS crosses_ends FROM (SELECT *, length(s_name) + s_suppkey AS n FROM supplier)")
def shared_ends(spark, d):
    k, n = F.col("s_nationkey").cast("long"), F.char_length("s_name") + F.col("s_suppkey")
    s = read_table(spark, d, "supplier").select("s_suppkey", (k % 3).alias("a_group_5"), (k % 2).alias("a_group_3"), (n % 3).alias("b_group_5"), (n % 2).alias("b_group_3"))
    return candidates.complementarity(s).select("s_suppkey", "shares_5prime", "shares_3prime", "shares_both_ends", "crosses_ends")


# ---- k-mers and ends ------------------------------------------------------


@query("""WITH s AS (SELECT p_partkey AS id, translate(substr(md5(p_name), 1, 30), '0123456789abcdef', 'ACGTACGTACGTACGT') AS s FROM part), k AS (SELECT id, unnest([substr(s, i, 4) for i in range(1, 28)]) AS w FROM s)
SELECT kmer, count(*) AS n FROM (SELECT least(w, translate(reverse(w), 'ACGT', 'TGCA')) AS kmer FROM k) GROUP BY kmer""")
def canonical_kmers(spark, d):
    s = _parts(spark, d).select("p_partkey", F.translate(F.left("s", F.lit(30)), "0123456789abcdef", "ACGTACGTACGTACGT").alias("s"))
    return kmers.kmer_counts(s, "p_partkey", "s", 4, canonical=True).groupBy("kmer").agg(F.sum("n").alias("n"))


@query("SELECT p_partkey AS query_id, p_size AS target_id, cast(p_size AS DOUBLE) AS identity, cast(100 AS DOUBLE) AS query_coverage, cast(1 AS BIGINT) AS num_alignments FROM part")
def kmer_edges(spark, d):
    p = read_table(spark, d, "part").select(F.col("p_partkey").alias("seq_a"), F.col("p_size").alias("seq_b"), (F.col("p_size") / 100).alias("overlap"))
    return kmers.overlap_edges(p).select("query_id", "target_id", "identity", "query_coverage", "num_alignments")


_AT = "len([1 for i in range(1, 9) if substr({x}, i, 1) = substr({y}, i, 1)]) / 8.0"


@query(f"WITH m AS (SELECT p_partkey, left(md5(p_name), 8) AS a, left(md5(p_type), 8) AS b, right(md5(p_name), 8) AS c, right(md5(p_type), 8) AS e FROM part) SELECT p_partkey, cast(least({_AT.format(x='a', y='b')}, {_AT.format(x='c', y='e')}) AS DOUBLE) AS identity FROM m")
def terminal_identity(spark, d):
    return _parts(spark, d).select("p_partkey", sq.terminal_identity(F.col("s"), F.md5("p_type"), 8).alias("identity"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'direct_terminal_repeat' ELSE '' END AS reasons, p_size % 2 = 0 AS risky FROM part")
def terminal_repeats(spark, d):
    text = F.concat("s", F.when(F.col("p_size") % 2 == 0, F.col("s")).otherwise(F.md5("p_type")))
    out = masking.repeat_risk(_parts(spark, d).select("id", text.alias("t")), "id", "t", edge=32, fraction=0.9)
    return out.select(F.col("seq_id").cast("long").alias("p_partkey"), F.array_join(F.array_intersect(F.split("reasons", ","), F.array(F.lit("direct_terminal_repeat"))), ",").alias("reasons")).withColumn("risky", F.col("reasons") != "")


@query("SELECT p_partkey, length(p_type) - length(b) BETWEEN 1 AND 3 AND contains(p_type, b) AS clipped FROM (SELECT *, substr(p_type, 2, length(p_type) - 1 - cast(p_size % 4 AS BIGINT)) AS b FROM part)")
def clipped_forms(spark, d):
    short = F.substr("p_type", F.lit(2), (F.char_length("p_type") - 1 - F.col("p_size") % 4).cast("int"))
    low, high = termini.parse_window("1-3")
    return _parts(spark, d).select("p_partkey", (sq.clipped_containment(F.col("p_type"), short, high) & F.lit(low == 1)).alias("clipped"))


def _ends(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", sq.upper_ascii(F.col("text")).alias("s"))
    return termini.signatures(docs, "doc_id", "s", 6, 12)


@query("SELECT doc_id AS contig_id, e.l AS end_label, CASE WHEN e.l = '5prime' THEN left(s, 6) ELSE right(s, 6) END AS motif_min FROM (SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS s FROM documents WHERE length(text) >= 6), (SELECT unnest(['5prime', '3prime']) AS l) e")
def one_signature_per_end(spark, d):
    return termini.one_per_end(_ends(spark, d)).select("contig_id", "end_label", "motif_min")


@query("""WITH f AS (SELECT left(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 12) AS f FROM documents WHERE length(text) >= 6),
n AS (SELECT left(f, 6) AS motif_min, f, k FROM f, range(6, 13) t(k)),
g AS (SELECT motif_min, k, count(DISTINCT left(f, k)) AS v, min(length(f)) AS s, min(left(f, k)) AS p FROM n GROUP BY ALL)
SELECT motif_min, arg_max(p, k) AS motif FROM g WHERE v = 1 AND k <= s GROUP BY motif_min""")
def extended_motifs(spark, d):
    sig = _ends(spark, d).where("strand_label = '+' and end_label = '5prime'")
    return termini.extend_motif(sig, ["motif_min"])


@query("""WITH s AS (SELECT 'd' || (doc_id % 7) AS a, left(lower(text), 2) AS m FROM documents WHERE length(text) >= 2), g AS (SELECT m AS motif, count(*) AS n, min(a) AS a FROM s GROUP BY 1 HAVING count(*) > 1), z AS (SELECT *, row_number() OVER (ORDER BY n DESC, motif) AS i FROM g)
SELECT 'group_id_' || i || '_mems_' || n || '_exmp_' || a || ':1-2:5prime' AS header, motif AS sequence FROM z""")
def group_headers(spark, d):
    docs = read_table(spark, d, "documents").where("length(text) >= 2")
    sig = docs.select(F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string")).alias("contig_id"), F.left(F.lower("text"), F.lit(2)).alias("motif_min"), F.lit(1).cast("long").alias("motif_start"), F.lit(2).cast("long").alias("motif_stop"), F.lit("5prime").alias("end_label"), F.lit("fwd").alias("found_in"))
    return termini.fasta_headers(termini.number_groups(termini.exact_groups(sig)), sig)


@query("SELECT p_brand AS cluster, arg_max(p_partkey, (length(p_type), -p_partkey)) AS p_partkey FROM part GROUP BY p_brand")
def longest_of_cluster(spark, d):
    p = read_table(spark, d, "part")
    assigned = p.select(F.col("p_partkey").alias("seq_id"), F.col("p_brand").alias("cluster_id"))
    longest = termini.cluster_longest(p.select("p_partkey", "p_brand", F.char_length("p_type").alias("n")), "p_partkey", "n", assigned)
    return longest.select(F.col("p_brand").alias("cluster"), "p_partkey")
