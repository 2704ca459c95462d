"""Sequence and table queries: document texts play sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..operators import filters, kmers, masking, tables
from ..session import read_table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


_CALC = "SELECT cast(doc_id AS VARCHAR) AS header, strlen(text) AS length, len(regexp_extract_all(text, '[GgCc]')) / nullif(length(text), 0) AS gc, len(regexp_extract_all(text, '[Nn]')) AS n_count, md5(text) AS hash FROM documents"


def _calc(spark: SparkSession, d: str) -> DataFrame:
    return tables.fastx_calc(_docs(spark, d).withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id", "text")


@query(f"SELECT header, length, round(gc, 6) AS gc_content, n_count, hash FROM ({_CALC})")
def fastx_calc(spark, d):
    return _calc(spark, d).withColumn("gc_content", F.round("gc_content", 6))


def _five(c, name):
    return f"min({c}) AS min_{name}, max({c}) AS max_{name}, round(avg({c}), 4) AS mean_{name}, median({c}) AS median_{name}, round(stddev_samp({c}), 4) AS std_{name}"


@query(f"""SELECT {_five('length', 'length')}, cast(sum(length) AS BIGINT) AS total_length,
  round(min(gc), 6) AS min_gc, round(max(gc), 6) AS max_gc, round(avg(gc), 6) AS mean_gc, round(median(gc), 6) AS median_gc, round(stddev_samp(gc), 6) AS std_gc,
  min(n_count) AS min_n, max(n_count) AS max_n, round(avg(n_count), 4) AS mean_n, cast(sum(n_count) AS BIGINT) AS total_n, count(*) AS total_sequences FROM ({_CALC})""")
def fastx_stats(spark, d):
    stats = tables.fastx_stats(_calc(spark, d))
    digits = {c: 6 if c.endswith("_gc") else 4 for c, t in stats.dtypes if t == "double" and c != "median_length"}
    return stats.withColumns({c: F.round(c, k) for c, k in digits.items()})


@query("SELECT doc_id, strlen(text) AS length FROM documents WHERE strlen(text) BETWEEN 500 AND 2000")
def length_range_filter(spark, d):
    return filters.length_range(_docs(spark, d), "text", 500, 2000).select("doc_id", F.octet_length("text").cast("long").alias("length"))


_AZ = "'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_COMPLEMENT = "'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN'"
_UP = f"translate(text, {_AZ})"


def _turned(s: str) -> str:
    """Characters in reverse order, one by one (a built-in reverse would keep clusters together)."""
    return f"translate(array_to_string(list_reverse(string_split({s}, '')), ''), {_COMPLEMENT})"


_RC = _turned(_UP)


@query(f"SELECT doc_id, md5({_RC}) AS rc FROM documents")
def revcomp(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(sq.revcomp(sq.upper_ascii(F.col("text")))).alias("rc"))


def _map(code=1):
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in (sq.translation_table(code) | {"---": "-"}).items()) + "}"


_CLEAN = rf"string_split(replace(translate(regexp_replace(text, '[ \t\n\x0B\f\r]+', '', 'g'), {_AZ}), 'U', 'T'), '')"


def _protein(strand: str, frame: int) -> str:
    """Of an array of characters."""
    return f"array_to_string([coalesce(m[{strand}[i + {frame}] || {strand}[i + {frame + 1}] || {strand}[i + {frame + 2}]], 'X') for i in range(0, len({strand}) - {frame + 1}, 3)], '')"


@query(f"WITH s AS (SELECT doc_id, {_CLEAN} AS s, {_map()} AS m FROM documents) SELECT doc_id, {_protein('s', 1)} AS protein FROM s")
def translate_frame(spark, d):
    return _docs(spark, d).select("doc_id", sq.translate(F.col("text")).alias("protein"))


_SIX = " UNION ALL ".join(f"SELECT doc_id, cast({f} AS INTEGER) AS frame, md5({_protein('s' if f > 0 else 'r', abs(f))}) AS protein FROM s" for f in sq.FRAMES)


@query(f"WITH c AS (SELECT doc_id, {_CLEAN} AS s, {_map(11)} AS m FROM documents), s AS (SELECT *, list_transform(list_reverse(s), lambda x: translate(x, {_COMPLEMENT})) AS r FROM c) {_SIX}")
def six_frame(spark, d):
    frames = _docs(spark, d).select("doc_id", F.explode(sq.six_frames(F.col("text"), 11)).alias("x"))
    return frames.select("doc_id", "x.frame", F.md5("x.protein").alias("protein"))


@query(f"""WITH s AS (SELECT doc_id, {_CLEAN} AS s, {_map()} AS m FROM documents),
p AS (SELECT doc_id, unnest(string_split({_protein('s', 1)}, '*')) AS orf FROM s)
SELECT doc_id, count(*) AS n_orfs, cast(max(length(orf)) AS BIGINT) AS longest FROM p WHERE length(orf) >= 16 GROUP BY doc_id""")
def open_reading_frames(spark, d):
    found = _docs(spark, d).select("doc_id", F.explode(sq.orfs(sq.translate(F.col("text")), 1, 16)).alias("o"))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_orfs"), F.max(F.char_length("o.protein")).cast("long").alias("longest"))


@query("SELECT doc_id, regexp_full_match(upper(text), '[ATGCUN]*') AS nucl, regexp_full_match(upper(text), '[ACDEFGHIKLMNPQRSTVWYXBZJUO*\\-]*') AS amino FROM documents")
def seq_type_flags(spark, d):
    return _docs(spark, d).select("doc_id", sq.is_nucleotide(F.col("text")).alias("nucl"), sq.is_protein(F.col("text")).alias("amino"))


@query(f"""WITH s AS (SELECT doc_id, string_split({_UP}, '') AS s FROM documents),
c AS (SELECT doc_id, unnest([s[i + 1] || s[i + 2] || s[i + 3] for i in range(0, len(s) - 2, 3)]) AS codon FROM s),
n AS (SELECT doc_id, codon, count(*) AS n FROM c WHERE NOT contains(codon, 'N') GROUP BY ALL)
SELECT doc_id, count(*) AS codons, round(max(n) / sum(n), 6) AS top_share FROM n GROUP BY doc_id""")
def codon_usage(spark, d):
    usage = _docs(spark, d).select("doc_id", sq.codon_usage(F.col("text")).alias("u")).where(F.size("u") > 0)
    return usage.select("doc_id", F.size("u").cast("long").alias("codons"), F.round(F.array_max(F.map_values("u")), 6).alias("top_share"))


@query("""SELECT p_partkey, list_avg([ord(c) - 33 for c in string_split(p_name, '')]) AS avg_quality, hamming(md5(p_name), md5(p_type)) AS distance,
  list_min([substr(p_type || p_type, i, length(p_type)) for i in range(1, length(p_type) + 1)]) AS rotation FROM part""")
def string_metrics(spark, d):
    p = read_table(spark, d, "part")
    return p.select("p_partkey", sq.avg_quality(F.col("p_name")).alias("avg_quality"), sq.hamming(F.md5("p_name"), F.md5("p_type")).cast("long").alias("distance"), sq.least_rotation("p_type").alias("rotation"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity + l_linenumber - l_linenumber) * 100.0 / (l_quantity + 3 * l_linenumber), 6) AS identity FROM lineitem")
def cigar_identity(spark, d):
    q = F.col("l_quantity").cast("long").cast("string")
    n = F.col("l_linenumber").cast("string")
    cigar = F.concat(n, F.lit("S"), q, F.lit("M"), n, F.lit("I"), n, F.lit("D"), n, F.lit("X"), F.lit("5H"))
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(sq.cigar_identity(cigar, F.col("l_linenumber")), 6).alias("identity"))


# ---- k-mers ---------------------------------------------------------------

_K3 = "SELECT doc_id, unnest([substr(s, i, 3) for i in range(1, length(s) - 1)]) AS kmer FROM (SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS s FROM documents)"


@query(f"SELECT kmer, cast(sum(n) AS BIGINT) AS n, count(*) AS sequences FROM (SELECT doc_id, kmer, count(*) AS n FROM ({_K3}) GROUP BY ALL) GROUP BY kmer")
def kmer_counts(spark, d):
    return kmers.kmer_counts(_docs(spark, d), "doc_id", "text", 3).groupBy("kmer").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sequences"))


@query(f"SELECT doc_id AS id, round(max(n) / sum(n), 6) AS top_share FROM (SELECT doc_id, kmer, count(*) AS n FROM ({_K3}) GROUP BY ALL) GROUP BY doc_id")
def kmer_relative(spark, d):
    return kmers.kmer_counts(_docs(spark, d), "doc_id", "text", 3, relative=True).groupBy("id").agg(F.round(F.max("share"), 6).alias("top_share"))


@query(f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM (SELECT doc_id, kmer, count(*) AS n FROM ({_K3}) GROUP BY ALL) WHERE n > 40)")
def kmer_repeat_filter(spark, d):
    return kmers.without_repetitive(_docs(spark, d), "doc_id", "text", 3, 40).select("doc_id")


@query("""WITH s AS (SELECT p_partkey AS id, md5(p_partkey || p_name) AS s FROM part),
k AS (SELECT DISTINCT id, unnest([substr(upper(s), i, 5) for i in range(1, length(s) - 3)]) AS kmer FROM s),
n AS (SELECT id, count(*) AS n FROM k GROUP BY id),
p AS (SELECT a.id AS seq_a, b.id AS seq_b, count(*) AS shared FROM k a JOIN k b ON a.kmer = b.kmer AND a.id < b.id GROUP BY ALL)
SELECT seq_a, seq_b, shared, round(shared / least(x.n, y.n), 4) AS overlap FROM p JOIN n x ON x.id = seq_a JOIN n y ON y.id = seq_b WHERE shared / least(x.n, y.n) >= 0.1""")
def kmer_overlap(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", F.md5(F.concat(F.col("p_partkey").cast("string"), F.col("p_name"))).alias("s"))
    return kmers.kmer_overlap(p, "p_partkey", "s", 5, 0.1, canonical=False, skip_ambiguous=False)


# ---- names and duplicates -------------------------------------------------


@query("SELECT doc_id AS old_id, 'CID' || lpad(cast(row_number() OVER (ORDER BY doc_id) AS VARCHAR), cast(length(cast(count(*) OVER () AS VARCHAR)) AS INTEGER), '0') AS new_id FROM documents")
def rename_number(spark, d):
    return tables.rename_numbered(_docs(spark, d), "doc_id", ["doc_id"])


@query("SELECT doc_id AS old_id, 'CID_' || md5(text) AS new_id FROM documents")
def rename_hash(spark, d):
    return tables.rename_hashed(_docs(spark, d), "doc_id", "text")


_FIRST = "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {key} ORDER BY doc_id) AS r FROM documents {where}) WHERE r = 1"


@query(_FIRST.format(key="coalesce(text, '')", where=""))
def dedup_exact(spark, d):
    return tables.deduplicate(_docs(spark, d), F.col("text"), ["doc_id"]).select("doc_id")


@query(_FIRST.format(key="upper(coalesce(text, ''))", where=""))
def dedup_ignorecase(spark, d):
    return tables.deduplicate(_docs(spark, d), tables.dedup_key("seq", "doc_id", "text", ignore_case=True), ["doc_id"]).select("doc_id")


@query(_FIRST.format(key=f"coalesce(least({_UP}, {_RC}), '')", where=""))
def dedup_revcomp(spark, d):
    return tables.deduplicate(_docs(spark, d), tables.dedup_key("seq", "doc_id", "text", revcomp=True), ["doc_id"]).select("doc_id")


@query("SELECT md5(coalesce(text, '')) AS hash, count(*) AS count, string_agg(doc_id, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_groups(spark, d):
    return filters.nested_to_text(tables.duplicate_groups(_docs(spark, d), F.col("text"), "doc_id"))


@query("SELECT l_orderkey, count(*) AS count FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return tables.duplicate_ids(read_table(spark, d, "lineitem"), "l_orderkey")


# ---- filters --------------------------------------------------------------


@query("SELECT doc_id, source FROM documents WHERE source IN ('src0', 'src3')")
def header_filter_exact(spark, d):
    wanted = spark.sql("select explode(array('src0', 'src3', 'src0')) as s")
    return filters.header_filter(_docs(spark, d), "source", wanted).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE source NOT IN ('src0', 'src3')")
def header_filter_invert(spark, d):
    wanted = spark.sql("select explode(array('src0', 'src3')) as s")
    return filters.header_filter(_docs(spark, d), "source", wanted, invert=True).select("doc_id", "source")


@query("SELECT page_id, url FROM pages WHERE contains(url, 'example.org') OR contains(url, '/de/')")
def header_filter_substring(spark, d):
    wanted = spark.sql("select explode(array('example.org', '/de/')) as s")
    return filters.header_filter(read_table(spark, d, "pages"), "url", wanted, substring=True).select("page_id", "url")


@query("SELECT page_id, split_part(regexp_replace(regexp_replace(url, '^https://', ''), '#top$', ''), ' ', 1) AS name, split_part(url, '_', 1) AS sample FROM pages")
def clean_header(spark, d):
    return read_table(spark, d, "pages").select("page_id", filters.clean_header(F.col("url"), "https://", "#top", True).alias("name"), filters.sample_id(F.col("url")).alias("sample"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE (l_quantity >= 45 OR l_discount > 0.08) AND l_tax < 0.02")
def dsl_filter(spark, d):
    return read_table(spark, d, "lineitem").where(filters.parse_filter("[l_quantity >= 45 | l_discount > 0.08 & l_tax < 0.02]")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND ((l_quantity >= 40 AND l_discount < 0.05) OR l_tax > 0.07))")
def exclude_hits(spark, d):
    return filters.exclude_hits(read_table(spark, d, "orders"), read_table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", ["[l_quantity >= 40 & l_discount < 0.05]", "[l_tax > 0.07]"]).select("o_orderkey")


@query("SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '(?i)economy|promo') AND p_size BETWEEN 10 AND 30")
def keyword_filter(spark, d):
    return filters.keyword_filter(read_table(spark, d, "part"), "p_type", ["economy", "promo"]).where(F.col("p_size").between(10, 30)).select("p_partkey", "p_type")


# ---- schemas --------------------------------------------------------------


@query("""SELECT type, source, strand, phase, evalue, count(*) AS n, round(sum(score), 2) AS score, cast(sum("start") AS BIGINT) AS start FROM (
  SELECT 'event' AS type, 'unknown' AS source, '+' AS strand, '.' AS phase, 1.0::DOUBLE AS evalue, value AS score, event_id AS "start" FROM events
  UNION ALL SELECT 'order', o_orderstatus, '+', '.', 1.0, o_totalprice, o_orderkey FROM orders) GROUP BY ALL""")
def unify_schemas(spark, d):
    ev = read_table(spark, d, "events").select(F.col("user_id").alias("contig_id"), F.col("event_id").alias("seq_from"), F.col("value").alias("bit_score"))
    od = read_table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("qstart"), F.col("o_totalprice").alias("score"), F.col("o_orderstatus").alias("tool"))
    u = filters.unify({"event": ev, "order": od})
    return u.groupBy("type", "source", "strand", "phase", "evalue").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 2).alias("score"), F.sum("start").alias("start"))


@query("""SELECT event_id, cast(json_extract(props, '$.k') AS BIGINT) AS "props:k" FROM events""")
def json_flatten(spark, d):
    ev = read_table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("props"))
    return filters.flatten_structs(ev)


@query("SELECT n.n_nationkey, n.n_name, r.r_name AS info_r_name FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey")
def enrich(spark, d):
    nation = read_table(spark, d, "nation").withColumn("k", F.col("n_regionkey").cast("string"))
    region = read_table(spark, d, "region").withColumn("rk", F.concat(F.lit(" "), F.col("r_regionkey").cast("string")))
    return filters.enrich(nation, region, "k", "rk", ["r_name"]).select("n_nationkey", "n_name", "info_r_name")


@query("""SELECT c_custkey, CASE WHEN o.k IS NULL THEN c_mktsegment ELSE 'ordered' END AS c_mktsegment FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) o ON o.k = c_custkey""")
def replace_rows(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    fresh = c.join(read_table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey").withColumn("c_mktsegment", F.lit("ordered"))
    return filters.replace_rows(c, fresh, "c_custkey")


@query("""SELECT doc_id, md5(CASE WHEN e > s THEN substr(text, 1, s) || repeat('N', cast(e - s AS INTEGER)) || substr(text, e + 1) ELSE text END) AS masked FROM (
  SELECT doc_id, text, cast(greatest(0, least(length(text), CASE WHEN toxic = 1 THEN length(text) - b - 9 ELSE b - 1 END)) AS BIGINT) AS s, cast(greatest(0, least(length(text), CASE WHEN toxic = 1 THEN length(text) - b + 1 ELSE b + 9 END)) AS BIGINT) AS e
  FROM (SELECT d.doc_id, d.text, l.toxic, l.doc_id % 50 + 1 AS b FROM documents d JOIN labels l ON d.doc_id = l.doc_id))""")
def range_mask(spark, d):
    lab = read_table(spark, d, "labels")
    b = F.col("doc_id") % 50 + 1
    ranges = lab.select(F.col("doc_id").alias("seq_id"), (b + 9).alias("start"), b.alias("stop"), F.when(F.col("toxic") == 1, "-").otherwise("+").alias("strand"))
    masked = masking.mask_by_table(_docs(spark, d), "doc_id", "text", ranges).join(lab.select("doc_id"), "doc_id", "left_semi")
    return masked.select("doc_id", F.md5("text").alias("masked"))


@query("SELECT l.doc_id, substr(text, 4, 12) AS sequence FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id")
def populate(spark, d):
    lab = read_table(spark, d, "labels").select("doc_id")
    return masking.populate(lab, _docs(spark, d), "doc_id", "doc_id", "text", F.lit(3), F.lit(15))


# ---- samples --------------------------------------------------------------


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':42'), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n, count(*) OVER () AS t FROM documents)
SELECT doc_id, lang FROM r WHERE r <= greatest(1, floor(n * 100 / t))""")
def stratified_sample(spark, d):
    return tables.stratified_sample(_docs(spark, d), "lang", "doc_id", 100).select("doc_id", "lang")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || ':42'), doc_id LIMIT 100")
def random_reads(spark, d):
    return tables.random_reads(_docs(spark, d), "doc_id", 101).select("doc_id")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC NULLS LAST, o_orderkey) AS r FROM orders) WHERE r = 1")
def best_record(spark, d):
    return tables.best_record(read_table(spark, d, "orders"), "o_custkey", [("o_orderpriority", False), ("o_totalprice", True)], "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT lang, count(*) AS count FROM documents GROUP BY lang")
def value_counts(spark, d):
    return tables.value_counts(_docs(spark, d), "lang")


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id FROM events GROUP BY ALL")
def last_by(spark, d):
    return tables.last_by(read_table(spark, d, "events"), ["user_id", "event_type"], "event_id", "event_id")


@query("SELECT cast(sum(n_chars * 1) AS BIGINT) AS total_bases, count(*) AS total_reads FROM documents")
def histogram_total(spark, d):
    return tables.histogram_total(_docs(spark, d).groupBy("n_chars").count(), "n_chars", "count")
