"""Interval and hit queries: line items play hits on an order (or supplier)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hits, intervals
from ..session import read_table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_HITS = """h0 AS (SELECT DISTINCT l_orderkey AS q, l_partkey, l_suppkey, l_linenumber, l_linenumber * 10 AS s, l_linenumber * 10 + cast(l_quantity AS BIGINT) AS e, l_extendedprice AS score FROM lineitem),
h AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, l_partkey, l_suppkey, l_linenumber) AS uid FROM h0)"""
_OUT = "q, l_partkey, l_suppkey, l_linenumber, cast(s AS BIGINT) AS s, e, score"
TIES = ["l_partkey", "l_suppkey", "l_linenumber"]


def _hits(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber") * 10
    return read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), "l_partkey", "l_suppkey", "l_linenumber", n.cast("long").alias("s"), (n + F.col("l_quantity").cast("long")).alias("e"), F.col("l_extendedprice").alias("score"))


def _consolidated(spark, d, mode, **kw):
    return intervals.consolidate(_hits(spark, d), mode, "q", "s", "e", "-score", TIES, **kw)


@query(f"WITH {_HITS} SELECT {_OUT} FROM h WHERE uid = 1")
def one_per_query(spark, d):
    return _consolidated(spark, d, "one_per_query")


_CONTAINED = "EXISTS (SELECT 1 FROM h o WHERE o.q = h.q AND o.uid <> h.uid AND o.s <= h.s AND o.e >= h.e AND (o.s < h.s OR o.e > h.e OR o.uid < h.uid))"


@query(f"WITH {_HITS} SELECT {_OUT} FROM h WHERE NOT {_CONTAINED}")
def drop_contained(spark, d):
    return _consolidated(spark, d, "drop_contained")


def _greedy(source: str, least: int) -> str:
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY uid) AS rn FROM {source}),
f(q, rn, ks, ke, kept) AS (SELECT q, rn, [s], [e], true FROM r WHERE rn = 1
  UNION ALL SELECT r.q, r.rn, CASE WHEN clash THEN ks ELSE list_append(ks, s) END, CASE WHEN clash THEN ke ELSE list_append(ke, e) END, NOT clash
  FROM (SELECT f.q, f.ks, f.ke, r.rn, r.s, r.e, len([i for i in range(1, len(f.ks) + 1) if least(f.ke[i], r.e) - greatest(f.ks[i], r.s) >= {least}]) > 0 AS clash FROM f JOIN r ON r.q = f.q AND r.rn = f.rn + 1) r)"""


@query(f"WITH RECURSIVE {_HITS}, {_greedy('h', 5)} SELECT {_OUT} FROM r JOIN f USING (q, rn) WHERE kept")
def one_per_range(spark, d):
    return _consolidated(spark, d, "one_per_range", least=5)


@query(f"WITH RECURSIVE {_HITS}, c AS (SELECT * FROM h WHERE NOT {_CONTAINED}), {_greedy('c', 10)} SELECT {_OUT} FROM r JOIN f USING (q, rn) WHERE kept")
def consolidate_simple(spark, d):
    return _consolidated(spark, d, "simple", least=10)


@query(f"""WITH {_HITS}, b AS (SELECT *, e - s + 1 < 15 AS short FROM h),
w AS (SELECT *, max(e) OVER (PARTITION BY q, short ORDER BY s, e, uid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM b),
i AS (SELECT *, sum(CASE WHEN short OR m IS NULL OR least(m, e) - s + 1 < 15 THEN 1 ELSE 0 END) OVER (PARTITION BY q, short ORDER BY s, e, uid ROWS UNBOUNDED PRECEDING) AS isl FROM w)
SELECT q, arg_min(l_partkey, uid) AS l_partkey, arg_min(l_suppkey, uid) AS l_suppkey, arg_min(l_linenumber, uid) AS l_linenumber, cast(min(s) AS BIGINT) AS s, max(e) AS e, arg_min(score, uid) AS score FROM i GROUP BY q, short, isl""")
def merge_overlapping(spark, d):
    return _consolidated(spark, d, "merge", least=15)


@query(f"""WITH {_HITS}, p AS (SELECT DISTINCT q, s AS x FROM h UNION SELECT q, e FROM h),
g AS (SELECT q, x AS a, lead(x) OVER (PARTITION BY q ORDER BY x) AS b FROM p),
o AS (SELECT g.q, a, b, min(uid) AS uid FROM g JOIN h ON h.q = g.q AND h.s <= a AND h.e >= b WHERE b IS NOT NULL GROUP BY ALL),
n AS (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY q, uid ORDER BY a) = a THEN 0 ELSE 1 END AS fresh FROM o),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY q, uid ORDER BY a ROWS UNBOUNDED PRECEDING) AS run FROM n),
j AS (SELECT q, uid, run, cast(min(a) AS BIGINT) AS s, max(b) AS e FROM r GROUP BY ALL)
SELECT j.q, l_partkey, l_suppkey, l_linenumber, j.s, j.e, score FROM j JOIN h USING (q, uid)""")
def split_ranges(spark, d):
    return _consolidated(spark, d, "split")


@query(f"WITH {_HITS} SELECT a.q, a.uid, string_agg(b.uid, ',' ORDER BY b.uid) AS overlaps FROM h a JOIN h b ON a.q = b.q AND a.uid <> b.uid AND least(a.e, b.e) - greatest(a.s, b.s) >= 3 GROUP BY a.q, a.uid")
def interval_overlaps(spark, d):
    ranked = intervals.with_uid(_hits(spark, d).distinct(), "q", "-score", TIES).withColumn("uid", F.col("uid").cast("long"))
    out = intervals.overlapping(ranked, "q", "s", "e", "uid", 3)
    return out.withColumn("overlaps", F.array_join("overlaps", ","))


@query(f"WITH {_HITS} SELECT a.q, a.uid, string_agg(b.uid, ',' ORDER BY b.uid) AS envelopes FROM h a JOIN h b ON a.q = b.q AND a.uid <> b.uid AND b.s <= a.s AND b.e >= a.e GROUP BY a.q, a.uid")
def interval_envelopes(spark, d):
    ranked = intervals.with_uid(_hits(spark, d).distinct(), "q", "-score", TIES).withColumn("uid", F.col("uid").cast("long"))
    out = intervals.enveloping(ranked, "q", "s", "e", "uid")
    return out.withColumn("envelopes", F.array_join("envelopes", ","))


_QLEN = "SELECT l_suppkey AS q, l_partkey AS t, l_linenumber * 10 AS s, l_linenumber * 10 + cast(l_quantity AS BIGINT) * 4 AS e, cast(400 AS BIGINT) AS qlen FROM lineitem"


def _domains(spark, d):
    n = F.col("l_linenumber") * 10
    return read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("q"), F.col("l_partkey").alias("t"), n.cast("long").alias("s"), (n + F.col("l_quantity").cast("long") * 4).alias("e"), F.lit(400).cast("long").alias("qlen"))


_POLY = f"d AS ({_QLEN}), k AS (SELECT q FROM d GROUP BY q HAVING count(*) >= 10 AND max(qlen) >= 200), b AS (SELECT q, least((s + e) // 2 // 50, 8) AS bin, t FROM d WHERE q IN (SELECT q FROM k)), r AS (SELECT q, bin FROM b GROUP BY ALL HAVING count(DISTINCT t) >= 3), p AS (SELECT q FROM r GROUP BY q HAVING count(*) >= 2)"


@query(f"WITH {_POLY} SELECT q FROM p")
def polyprotein(spark, d):
    return intervals.polyproteins(_domains(spark, d), "q", "t", "s", "e", "qlen")


@query(f"WITH {_POLY} SELECT cast(min(CASE WHEN q IN (SELECT q FROM p) THEN CASE WHEN e - s < 100 THEN 5 WHEN e - s < 200 THEN 8 WHEN e - s < 400 THEN 12 ELSE 15 END ELSE CASE WHEN e - s < 100 THEN 10 WHEN e - s < 200 THEN 15 WHEN e - s < 400 THEN 25 ELSE 40 END END) AS INTEGER) AS overlap_limit FROM d")
def adaptive_threshold(spark, d):
    return intervals.adaptive_limit(_domains(spark, d), "q", "t", "s", "e", "qlen")


# ---- hits to edges --------------------------------------------------------

_HSP = """x AS (SELECT l_suppkey AS query_id, l_partkey % 50 AS target_id, 100 - 100 * l_discount AS pident, l_quantity AS length,
  l_linenumber * 10 AS qstart, l_linenumber * 10 + cast(l_quantity AS BIGINT) AS qend, l_linenumber * 7 AS sstart, l_linenumber * 7 + cast(l_quantity AS BIGINT) AS send, cast(120 AS BIGINT) AS qlen, cast(150 AS BIGINT) AS slen, CASE WHEN l_linenumber = 6 THEN 0.5 ELSE 0.0001 END AS evalue, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem),
c AS (SELECT *, qend - qstart + 1 AS span FROM x WHERE query_id <> target_id AND evalue <= 0.001),
w AS (SELECT *, sum(span) OVER (PARTITION BY query_id, target_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice ROWS UNBOUNDED PRECEDING) - span AS cum FROM c),
k AS (SELECT * FROM w WHERE cum < qlen AND span + cum < 1.10 * qlen)"""
_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def _hsps(spark, d):
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("long")
    return read_table(spark, d, "lineitem").select(F.col("l_suppkey").alias("query_id"), (F.col("l_partkey") % 50).alias("target_id"), (100 - 100 * F.col("l_discount")).alias("pident"), F.col("l_quantity").alias("length"), (n * 10).cast("long").alias("qstart"), (n * 10 + q).alias("qend"), (n * 7).cast("long").alias("sstart"), (n * 7 + q).alias("send"), F.lit(120).cast("long").alias("qlen"), F.lit(150).cast("long").alias("slen"), F.when(n == 6, 0.5).otherwise(0.0001).alias("evalue"), *_ORDER)


@query(f"WITH {_HSP} SELECT query_id, target_id, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM k")
def hsp_prune(spark, d):
    kept = hits.prune_hsps(hits.drop_self_hits(_hsps(spark, d)), "query_id", "target_id", "qlen", _ORDER)
    return kept.select("query_id", "target_id", *_ORDER)


def _axis(name, s, e, n):
    return f"""{name}0 AS (SELECT query_id, target_id, {n} AS n, greatest(0, {e} - greatest({s}, coalesce(max({e}) OVER (PARTITION BY query_id, target_id ORDER BY {s}, {e} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, {s})) + 1) AS fresh FROM k),
{name} AS (SELECT query_id, target_id, round(sum(fresh) * 100.0 / max(n), 2) AS cov FROM {name}0 GROUP BY ALL)"""


_EDGES = f"""{_HSP}, {_axis('qc', 'qstart', 'qend', 'qlen')}, {_axis('tc', 'sstart', 'send', 'slen')},
st AS (SELECT query_id, target_id, round(sum(length * pident) / sum(length), 2) AS identity, count(*) AS num_alignments FROM k GROUP BY ALL),
ed AS (SELECT st.query_id, st.target_id, identity, qc.cov AS query_coverage, tc.cov AS target_coverage, num_alignments FROM st JOIN qc USING (query_id, target_id) JOIN tc USING (query_id, target_id))"""


def _edges(spark, d):
    return hits.hsps_to_edges(_hsps(spark, d), _ORDER)


@query(f"WITH {_EDGES} SELECT * FROM ed")
def hsp_edges(spark, d):
    return _edges(spark, d)


@query(f"WITH {_HSP}, {_axis('qc', 'qstart', 'qend', 'qlen')} SELECT * FROM qc")
def hsp_coverage(spark, d):
    kept = hits.prune_hsps(hits.drop_self_hits(_hsps(spark, d)), "query_id", "target_id", "qlen", _ORDER)
    return hits.pair_coverage(kept, "query_id", "target_id", {"query": ("qstart", "qend", "qlen")}).withColumnRenamed("query_coverage", "cov")


@query(f"""WITH {_EDGES}, h AS (SELECT query_id, target_id, (cast(round(identity * 100) AS BIGINT) * cast(round(query_coverage * 100) AS BIGINT) + 5000) // 10000 AS gq, (cast(round(identity * 100) AS BIGINT) * cast(round(target_coverage * 100) AS BIGINT) + 5000) // 10000 AS gt FROM ed),
g AS (SELECT *, gq / 100.0 AS global_ani_query, gt / 100.0 AS global_ani_target FROM h),
l AS (SELECT s_suppkey AS seq_id, cast(s_nationkey + 1 AS BIGINT) AS length FROM supplier)
SELECT query_id, target_id, cast(global_ani_query AS DOUBLE) AS global_ani_query, cast(global_ani_target AS DOUBLE) AS global_ani_target, cast(CASE WHEN la + lb = 0 THEN 0.0 ELSE (2 * (gq * la + gt * lb) + la + lb) // (2 * (la + lb)) / 100.0 END AS DOUBLE) AS tani
FROM (SELECT g.*, coalesce(a.length, 0) AS la, coalesce(b.length, 0) AS lb FROM g LEFT JOIN l a ON a.seq_id = query_id LEFT JOIN l b ON b.seq_id = target_id)""")
def tani(spark, d):
    lengths = read_table(spark, d, "supplier").select(F.col("s_suppkey").alias("seq_id"), (F.col("s_nationkey") + 1).cast("long").alias("length"))
    return hits.with_global_ani(_edges(spark, d), lengths).select("query_id", "target_id", "global_ani_query", "global_ani_target", "tani")


@query(f"WITH {_EDGES} SELECT * FROM ed WHERE identity >= 94 AND target_coverage >= 50 AND least(query_coverage, target_coverage) >= 40")
def edge_filter(spark, d):
    return hits.filter_edges(_edges(spark, d), "identity", 94.0, 0.0, 50.0, 40.0)


@query(f"WITH {_EDGES} SELECT a.query_id, a.target_id, a.identity, a.query_coverage, coalesce(b.query_coverage, a.target_coverage) AS target_coverage, a.num_alignments FROM ed a LEFT JOIN ed b ON b.query_id = a.target_id AND b.target_id = a.query_id")
def reverse_coverage(spark, d):
    return hits.reverse_coverage(_edges(spark, d)).select("query_id", "target_id", "identity", "query_coverage", "target_coverage", "num_alignments")


@query("SELECT quantile_disc(n_chars, 0.25) AS fragment_length FROM documents")
def fragment_length(spark, d):
    return hits.fragment_length(read_table(spark, d, "documents"), "n_chars")
