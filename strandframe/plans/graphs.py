"""Graph, matrix, terminus, tree and motif queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..operators import candidates, clusters, correlate, motifs, taxonomy, termini
from ..operators.components import connected_components
from ..session import read_table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- clusters: parts of one brand and size form chains --------------------

_CHAIN = "e AS (SELECT cast(p_partkey AS VARCHAR) AS query_id, cast(n AS VARCHAR) AS target_id FROM (SELECT p_partkey, lead(p_partkey) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS n FROM part) WHERE n IS NOT NULL)"
_REACH = f"{_CHAIN}, v AS (SELECT query_id AS a, target_id AS b FROM e UNION SELECT target_id, query_id FROM e), r(a, b) AS (SELECT a, b FROM v UNION SELECT r.a, v.b FROM r JOIN v ON v.a = r.b), m AS (SELECT a AS id, least(a, min(b)) AS component FROM r GROUP BY a)"
_ASSIGN = f"{_REACH}, q AS (SELECT cast(p_partkey AS VARCHAR) AS seq_id, coalesce(component, cast(p_partkey AS VARCHAR)) AS root FROM part LEFT JOIN m ON id = cast(p_partkey AS VARCHAR)), asg AS (SELECT seq_id, 'cluster_' || (dense_rank() OVER (ORDER BY root) - 1) AS cluster_id, root AS representative_id, seq_id = root AS is_representative FROM q)"


def _chain(spark: SparkSession, d: str) -> DataFrame:
    nxt = F.lead("p_partkey").over(Window.partitionBy("p_brand", "p_size").orderBy("p_partkey"))
    return read_table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("query_id"), nxt.cast("string").alias("target_id")).where("target_id is not null")


def _nodes(spark, d):
    return read_table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("seq_id"), (F.col("p_retailprice") * 10).cast("long").alias("length"))


def _assigned(spark, d):
    return clusters.component_clusters(_nodes(spark, d), _chain(spark, d))


@query(f"WITH RECURSIVE {_REACH} SELECT id, component FROM m")
def components(spark, d):
    return connected_components(_chain(spark, d), "query_id", "target_id")


@query(f"WITH RECURSIVE {_ASSIGN} SELECT * FROM asg")
def component_clusters(spark, d):
    return _assigned(spark, d)


@query("""WITH RECURSIVE x AS (SELECT cast(p_partkey AS VARCHAR) AS id, p_brand, p_size, cast(trunc(p_retailprice * 10) AS BIGINT) AS length,
  [cast(lag(p_partkey) OVER w AS VARCHAR), cast(lead(p_partkey) OVER w AS VARCHAR)] AS near FROM part WINDOW w AS (PARTITION BY p_brand, p_size ORDER BY p_partkey)),
o AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY length DESC, id) AS rn FROM x),
f(p_brand, p_size, rn, id, rep, heads) AS (SELECT p_brand, p_size, rn, id, id, [id] FROM o WHERE rn = 1
  UNION ALL SELECT o.p_brand, o.p_size, o.rn, o.id, coalesce(list_filter(f.heads, lambda c: list_contains(o.near, c))[1], o.id), CASE WHEN len(list_filter(f.heads, lambda c: list_contains(o.near, c))) > 0 THEN f.heads ELSE list_append(f.heads, o.id) END
  FROM f JOIN o ON o.p_brand = f.p_brand AND o.p_size = f.p_size AND o.rn = f.rn + 1),
k AS (SELECT f.id, row_number() OVER (ORDER BY length DESC, f.id) - 1 AS k FROM f JOIN o ON o.id = f.id WHERE f.id = f.rep)
SELECT f.id AS seq_id, 'cluster_' || k AS cluster_id, rep AS representative_id, f.id = rep AS is_representative FROM f JOIN k ON k.id = rep""")
def centroid_clusters(spark, d):
    return clusters.centroid_clusters(_nodes(spark, d), _chain(spark, d))


@query(f"WITH RECURSIVE {_ASSIGN} SELECT cluster_id, min(representative_id) AS representative_id, count(*) AS member_count, string_agg(seq_id, ';' ORDER BY NOT is_representative, seq_id) AS members FROM asg GROUP BY cluster_id")
def cluster_summary(spark, d):
    return clusters.cluster_summary(_assigned(spark, d))


@query(f"WITH RECURSIVE {_ASSIGN}, z AS (SELECT cluster_id, count(DISTINCT seq_id) AS n FROM asg GROUP BY cluster_id) SELECT count(*) AS clusters, cast(sum(n) AS BIGINT) AS sequences, count(*) FILTER (n = 1) AS singletons, max(n) AS largest FROM z")
def cluster_stats(spark, d):
    return clusters.cluster_stats(_assigned(spark, d))


@query(f"""WITH RECURSIVE {_ASSIGN}, i AS (SELECT cast(p_partkey AS VARCHAR) AS seq_id, CASE WHEN p_partkey % 2 = 0 THEN 'a' ELSE 'b' END AS marker_type, p_type AS sample_id, p_size AS seq_length FROM part)
SELECT cluster_id, count(*) AS member_count, count(*) FILTER (marker_type = 'a') AS n_a, count(*) FILTER (marker_type = 'b') AS n_b, count(DISTINCT sample_id) AS n_samples, first(seq_id ORDER BY seq_length DESC, seq_id) AS longest_member, bool_or(marker_type = 'a') AS has_a FROM asg JOIN i USING (seq_id) GROUP BY cluster_id""")
def marker_summary(spark, d):
    info = read_table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("seq_id"), F.when(F.col("p_partkey") % 2 == 0, "a").otherwise("b").alias("marker_type"), F.col("p_type").alias("sample_id"), F.col("p_size").alias("seq_length"))
    return clusters.marker_summary(_assigned(spark, d), info)


@query("SELECT user_id, " + ", ".join(f"cast(count(*) FILTER (event_type = '{t}') > 0 AS INTEGER) AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY user_id")
def presence_pivot(spark, d):
    return clusters.presence_matrix(read_table(spark, d, "events"), "user_id", "event_type", ["click", "error", "purchase", "signup", "view"])


@query("""WITH j AS (SELECT p_brand AS ca, p_type AS cb FROM part),
b AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT count(*) AS n FROM j GROUP BY ca, cb)), x AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT count(*) AS n FROM j GROUP BY ca)), y AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT count(*) AS n FROM j GROUP BY cb))
SELECT cast(b.p AS DOUBLE) AS both_pairs, cast(x.p AS DOUBLE) AS a_pairs, cast(y.p AS DOUBLE) AS b_pairs, round(b.p / (x.p + y.p - b.p), 6) AS jaccard, cast(x.p + y.p - 2 * b.p AS DOUBLE) AS disagreeing FROM b, x, y""")
def backend_agreement(spark, d):
    p = read_table(spark, d, "part")
    side = lambda c: p.select(F.col("p_partkey").alias("seq_id"), F.col(c).alias("cluster_id"))
    return clusters.agreement(side("p_brand"), side("p_type"))


# ---- correlation: nations over years --------------------------------------

_GRID = """c AS (SELECT cast(c_nationkey AS BIGINT) AS contig_id, year(o_orderdate) AS sample, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
g AS (SELECT k.contig_id, y.sample, cast(coalesce(n, 0) AS DOUBLE) AS value FROM (SELECT DISTINCT contig_id FROM c) k CROSS JOIN (SELECT DISTINCT sample FROM c) y LEFT JOIN c USING (contig_id, sample))"""


def _matrix(spark, d):
    j = read_table(spark, d, "orders").join(read_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    wide = j.withColumn("y", F.year("o_orderdate")).groupBy(F.col("c_nationkey").cast("long").alias("nation")).pivot("y").count()
    return correlate.to_long(wide, "nation", wide.columns[1:])


def _corr(source: str) -> str:
    return f"SELECT a.contig_id AS contig_1, b.contig_id AS contig_2, corr(a.value, b.value) AS c FROM {source} a JOIN {source} b ON a.sample = b.sample AND a.contig_id > b.contig_id GROUP BY ALL"


@query(f"WITH {_GRID} SELECT contig_1, contig_2, round(c, 6) AS correlation FROM ({_corr('g')}) WHERE c >= 0.5")
def correlate_pearson(spark, d):
    return correlate.correlation_pairs(_matrix(spark, d), "pearson", 0.5).withColumn("correlation", F.round("correlation", 6))


@query(f"WITH {_GRID}, k AS (SELECT contig_id, sample, rank() OVER (PARTITION BY contig_id ORDER BY value) + (count(*) OVER (PARTITION BY contig_id, value) - 1) / 2.0 AS value FROM g) SELECT contig_1, contig_2, round(c, 6) AS correlation FROM ({_corr('k')}) WHERE c >= 0.505")
def correlate_spearman(spark, d):
    return correlate.correlation_pairs(_matrix(spark, d), "spearman", 0.505).withColumn("correlation", F.round("correlation", 6))


_CO = f"{_GRID}, a AS (SELECT contig_id, avg(value) AS m FROM g GROUP BY ALL), h AS (SELECT contig_id, sample FROM g JOIN a USING (contig_id) WHERE value > m), n AS (SELECT contig_id, count(*) AS n FROM h GROUP BY ALL), p AS (SELECT a.contig_id AS contig_1, b.contig_id AS contig_2, count(*) AS shared_samples FROM h a JOIN h b ON a.sample = b.sample AND a.contig_id > b.contig_id GROUP BY ALL HAVING count(*) >= 3)"


def _relative(spark, d):
    m = _matrix(spark, d)
    return m.join(m.groupBy("contig_id").agg(F.avg("value").alias("m")), "contig_id").select("contig_id", "sample", (F.col("value") - F.col("m")).alias("value"))


@query(f"WITH {_CO} SELECT contig_1, contig_2, shared_samples, round(shared_samples / (x.n + y.n - shared_samples), 6) AS shared_fraction FROM p JOIN n x ON x.contig_id = contig_1 JOIN n y ON y.contig_id = contig_2")
def cooccurrence(spark, d):
    return correlate.cooccurrence_pairs(_relative(spark, d), 0.0, 3).withColumn("shared_fraction", F.round("shared_fraction", 6))


@query(f"""WITH RECURSIVE {_GRID}, z AS (SELECT contig_1, contig_2 FROM ({_corr('g')}) WHERE c >= 0.9), v AS (SELECT contig_1 AS a, contig_2 AS b FROM z UNION SELECT contig_2, contig_1 FROM z), r(a, b) AS (SELECT a, b FROM v UNION SELECT r.a, v.b FROM r JOIN v ON v.a = r.b), m AS (SELECT a, least(a, min(b)) AS c FROM r GROUP BY a)
SELECT 'group_' || row_number() OVER (ORDER BY count(*) DESC, c) AS group_id, count(*) AS member_count, string_agg(a, ';' ORDER BY a) AS members FROM m GROUP BY c""")
def correlation_groups(spark, d):
    return correlate.groups(correlate.correlation_pairs(_matrix(spark, d), "pearson", 0.9))


# ---- termini --------------------------------------------------------------

_AZ = "'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
_ENDS = """d AS (SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS s FROM documents WHERE length(text) >= 6),
sig AS (SELECT doc_id, '5prime' AS end_label, 'fwd_on_5_end' AS found, substr(s, 1, 6) AS motif FROM d UNION ALL SELECT doc_id, '3prime', 'fwd_on_3_end', right(s, 6) FROM d
  UNION ALL SELECT doc_id, '3prime', 'rc_on_3_end', translate(translate(right(s, 6), 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN'), 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN') FROM d UNION ALL SELECT doc_id, '5prime', 'rc_on_5_end', translate(translate(substr(s, 1, 6), 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN'), 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN') FROM d)"""
_SIG = _ENDS  # an end that is turned twice is the end with each letter complemented twice


def _signatures(spark, d, most=6):
    docs = read_table(spark, d, "documents").select("doc_id", sq.upper_ascii(F.col("text")).alias("s"))
    return termini.signatures(docs, "doc_id", "s", 6, most)


@query(f"WITH {_SIG} SELECT motif, count(*) AS member_count, count(DISTINCT doc_id) AS n_members, string_agg(DISTINCT found, ',' ORDER BY found) AS found_in, CASE WHEN count(DISTINCT end_label) = 1 THEN min(end_label) ELSE 'mixed' END AS end_label FROM sig GROUP BY motif HAVING count(*) > 1")
def termini_exact(spark, d):
    g = termini.exact_groups(_signatures(spark, d))
    return g.select("motif", "member_count", F.size("members").cast("long").alias("n_members"), F.array_join("found_in", ",").alias("found_in"), "end_label")


_GROUPS = f"{_SIG}, gr AS (SELECT motif, count(*) AS member_count, CASE WHEN count(DISTINCT end_label) = 1 THEN min(end_label) ELSE 'mixed' END AS end_label FROM sig GROUP BY motif HAVING count(*) > 1), num AS (SELECT motif, row_number() OVER (ORDER BY end_label, member_count DESC, motif) AS g FROM gr)"


@query(f"""WITH {_GROUPS}, b AS (SELECT doc_id, end_label, min(g) AS g FROM sig JOIN num USING (motif) GROUP BY ALL), i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM d)
SELECT i.doc_id AS contig_id, coalesce(x.g, -(2 * i - 1)) AS group_5prime, coalesce(y.g, -(2 * i)) AS group_3prime FROM i LEFT JOIN b x ON x.doc_id = i.doc_id AND x.end_label = '5prime' LEFT JOIN b y ON y.doc_id = i.doc_id AND y.end_label = '3prime'""")
def termini_membership(spark, d):
    sig = _signatures(spark, d)
    groups = termini.number_groups(termini.exact_groups(sig))
    docs = sig.select("contig_id").distinct()
    return termini.membership(docs, "contig_id", groups, sig)


@query("""WITH c AS (SELECT lang, i AS pos, substr(text, i, 1) AS ch, count(*) AS n FROM documents, range(1, 13) t(i) WHERE length(text) >= i GROUP BY ALL), w AS (SELECT lang, pos, first(ch ORDER BY n DESC, ch) AS ch FROM c GROUP BY ALL)
SELECT lang, string_agg(ch, '' ORDER BY pos) AS consensus FROM w GROUP BY lang""")
def consensus(spark, d):
    return termini.consensus(read_table(spark, d, "documents").select("lang", F.left("text", F.lit(12)).alias("m")), ["lang"], "m")


@query("""WITH RECURSIVE g AS (SELECT substr(md5(p_brand || p_size), 1 + p_partkey % 3, 8 + p_partkey % 4) AS motif, min(p_partkey) AS group_id, count(*) AS n FROM part GROUP BY 1),
e AS (SELECT x.group_id AS a, y.group_id AS b FROM g x JOIN g y ON length(x.motif) - length(y.motif) BETWEEN 1 AND 2 AND contains(x.motif, y.motif)), v AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT a, b FROM v UNION SELECT r.a, v.b FROM r JOIN v ON v.a = r.b), c AS (SELECT a, least(a, min(b)) AS root FROM r GROUP BY a)
SELECT coalesce(root, group_id) AS group_id, arg_min(motif, (-length(motif), -n, group_id)) AS motif, cast(sum(n) AS BIGINT) AS member_count, cast(count(*) AS INTEGER) AS sources FROM g LEFT JOIN c ON a = group_id GROUP BY 1""")
def clip_collapse(spark, d):
    motif = F.substr(F.md5(F.concat("p_brand", F.col("p_size").cast("string"))), (F.col("p_partkey") % 3 + 1).cast("int"), (F.col("p_partkey") % 4 + 8).cast("int"))
    groups = read_table(spark, d, "part").groupBy(motif.alias("motif")).agg(F.min("p_partkey").alias("group_id"), F.count(F.lit(1)).alias("member_count"), F.collect_list("p_partkey").alias("members"))
    return termini.collapse_clipped(groups, 2).select("group_id", "motif", "member_count", F.size("source_group_ids").alias("sources"))


# ---- candidates, trees, motifs --------------------------------------------


@query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b, a.s_acctbal AS a_balance, b.s_acctbal AS b_balance, n.n_name AS a_nation, m.n_name AS b_nation, a.s_acctbal > 0 AND b.s_acctbal > 0 AS solid
FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey LEFT JOIN nation n ON n.n_nationkey = a.s_nationkey LEFT JOIN nation m ON m.n_nationkey = b.s_nationkey""")
def candidate_pairs(spark, d):
    s = read_table(spark, d, "supplier")
    x, y = s.alias("x"), s.alias("y")
    pairs = x.join(y, (F.col("x.s_nationkey") == F.col("y.s_nationkey")) & (F.col("x.s_suppkey") < F.col("y.s_suppkey"))).select(F.col("x.s_suppkey").alias("a"), F.col("y.s_suppkey").alias("b"))
    money = s.select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    home = s.join(read_table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("nation"))
    return candidates.candidate_pairs(pairs, [money, home]).withColumn("solid", (F.col("a_balance") > 0) & (F.col("b_balance") > 0)).select("a", "b", "a_balance", "b_balance", "a_nation", "b_nation", "solid")


_TREE = """nd AS (SELECT cast(0 AS BIGINT) AS tax_id, cast(NULL AS BIGINT) AS parent, 'root' AS rank, 'root' AS name UNION ALL SELECT 1 + r_regionkey, 0, 'region', r_name FROM region UNION ALL SELECT 100 + n_nationkey, 1 + n_regionkey, 'nation', n_name FROM nation UNION ALL SELECT 100000 + c_custkey, 100 + c_nationkey, 'customer', c_name FROM customer),
cl(tax_id, anc, dist) AS (SELECT tax_id, tax_id, cast(0 AS INTEGER) FROM nd UNION ALL SELECT cl.tax_id, nd.parent, dist + 1 FROM cl JOIN nd ON nd.tax_id = cl.anc WHERE nd.parent IS NOT NULL),
av AS (SELECT tax_id, tax_id % 3 = 0 AS available FROM nd WHERE rank = 'customer')"""


def _tree(spark, d):
    part = lambda t, i, p, r, n: read_table(spark, d, t).select(i.cast("long").alias("tax_id"), p.cast("long").alias("parent_tax_id"), F.lit(r).alias("rank"), F.col(n).alias("scientific_name"))
    c = F.col
    root = spark.sql("select 0L as tax_id, cast(null as bigint) as parent_tax_id, 'root' as rank, 'root' as scientific_name")
    return root.union(part("region", c("r_regionkey") + 1, F.lit(0), "region", "r_name")).union(part("nation", c("n_nationkey") + 100, c("n_regionkey") + 1, "nation", "n_name")).union(part("customer", c("c_custkey") + 100000, c("c_nationkey") + 100, "customer", "c_name"))


def _available(nodes):
    return nodes.where("rank = 'customer'").select("tax_id", (F.col("tax_id") % 3 == 0).alias("available"))


@query(f"WITH RECURSIVE {_TREE} SELECT cl.tax_id, string_agg(nd.name, ';' ORDER BY dist DESC) AS lineage FROM cl JOIN nd ON nd.tax_id = cl.anc GROUP BY cl.tax_id")
def taxonomy_lineage(spark, d):
    nodes = _tree(spark, d)
    return taxonomy.lineage(nodes, taxonomy.closure(nodes))


@query(f"WITH RECURSIVE {_TREE}, up AS (SELECT anc, count(*) AS n, count(*) FILTER (available) AS k FROM cl JOIN av USING (tax_id) GROUP BY anc) SELECT anc AS tax_id, k * 2 > n AS available FROM up")
def taxonomy_propagate(spark, d):
    nodes = _tree(spark, d)
    return taxonomy.propagate(taxonomy.closure(nodes), _available(nodes), "majority")


@query(f"WITH RECURSIVE {_TREE}, g AS (SELECT tax_id FROM nd WHERE rank <> 'customer' AND tax_id % 2 = 0) SELECT tax_id, arg_min(anc, dist) AS ancestor, min(dist) AS distance FROM cl WHERE anc IN (SELECT tax_id FROM g) GROUP BY tax_id")
def taxonomy_nearest_ancestor(spark, d):
    nodes = _tree(spark, d)
    data = nodes.where("rank <> 'customer'").select("tax_id", (F.col("tax_id") % 2 == 0).alias("available"))
    return taxonomy.nearest_ancestor(taxonomy.closure(nodes), nodes, data)


@query(f"WITH RECURSIVE {_TREE}, s AS (SELECT DISTINCT o_orderpriority || (o_orderkey % 200) AS set_id, 100000 + o_custkey AS tax_id FROM orders), z AS (SELECT set_id, count(*) AS n FROM s GROUP BY 1), h AS (SELECT set_id, anc, count(*) AS k, sum(dist) AS far FROM s JOIN cl USING (tax_id) GROUP BY ALL) SELECT set_id, arg_min(anc, far) AS lca FROM h JOIN z USING (set_id) WHERE k = n GROUP BY set_id")
def taxonomy_lca(spark, d):
    sets = read_table(spark, d, "orders").select(F.concat("o_orderpriority", (F.col("o_orderkey") % 200).cast("string")).alias("set_id"), (F.col("o_custkey") + 100000).alias("tax_id"))
    return taxonomy.lowest_common_ancestor(taxonomy.closure(_tree(spark, d)), sets)


@query(f"WITH RECURSIVE {_TREE} SELECT rank, count(*) AS nodes, count(*) FILTER (coalesce(available, false)) AS with_data FROM nd LEFT JOIN av USING (tax_id) GROUP BY rank")
def taxonomy_rank_stats(spark, d):
    nodes = _tree(spark, d)
    return taxonomy.rank_stats(nodes, _available(nodes))


@query(f"""WITH RECURSIVE {_TREE}, p AS (SELECT q.tax_id, x.tax_id AS leaf, q.dist + x.dist AS total, q.dist AS up FROM cl q JOIN cl x ON x.anc = q.anc JOIN av ON av.tax_id = x.tax_id AND available WHERE x.tax_id <> q.tax_id AND q.dist + x.dist <= 10)
SELECT tax_id, arg_min(leaf, (total, up, leaf)) AS leaf, min(total) AS distance FROM p GROUP BY tax_id""")
def taxonomy_nearest_leaf(spark, d):
    nodes = _tree(spark, d)
    return taxonomy.nearest_leaf(taxonomy.closure(nodes), nodes, _available(nodes))


def _motif_hits(spark, d):
    kind = F.element_at(F.array(*[F.lit(t) for t in "ABCD"]), (F.col("event_id") % 4 + 1).cast("int"))
    at = (F.col("event_id") * 37 % 900).cast("long")
    return read_table(spark, d, "events").select(F.col("user_id").cast("string").alias("query_name"), kind.alias("motif_type"), F.col("event_type").alias("motif_profile"), at.alias("ali_from"), (at + 15).alias("ali_to"), F.col("value").alias("score"), F.lit(1e-5).alias("evalue"))


_FITS = "NOT list_contains(f.ts, o.t) AND len([j for j in range(1, len(f.ts) + 1) if NOT ((o.s > f.es[j] OR o.e < f.ss[j]) AND greatest(o.s - f.es[j], f.ss[j] - o.e) <= 200)]) = 0"


@query(f"""WITH RECURSIVE h AS (SELECT cast(user_id AS VARCHAR) AS q, ['A', 'B', 'C', 'D'][event_id % 4 + 1] AS t, event_id * 37 % 900 AS s, event_id * 37 % 900 + 15 AS e, value AS score FROM events),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, s, e, t) AS i FROM h WHERE score > CASE t WHEN 'A' THEN 10 WHEN 'B' THEN 11 WHEN 'C' THEN 5.9 ELSE 5 END),
f(q, k, i, ts, ss, es, total) AS (SELECT q, i, cast(0 AS BIGINT), [t], [s], [e], score FROM o
  UNION ALL SELECT q, k, i, CASE WHEN fits THEN list_append(ts, t) ELSE ts END, CASE WHEN fits THEN list_append(ss, s) ELSE ss END, CASE WHEN fits THEN list_append(es, e) ELSE es END, CASE WHEN fits THEN total + score ELSE total END
  FROM (SELECT f.q, f.k, o.i, f.ts, f.ss, f.es, f.total, o.t, o.s, o.e, o.score, {_FITS} AS fits FROM f JOIN o ON o.q = f.q AND o.i = f.i + 1)),
z AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY total DESC, list_min(ss), k) AS r FROM f JOIN (SELECT q, max(i) AS i FROM o GROUP BY q) USING (q, i))
SELECT q AS query_name, round(total, 6) AS total_score, array_to_string(list_sort(ts), ';') AS motif_types, list_min(ss) AS first, list_max(es) AS last, cast(len(ts) AS INTEGER) AS n_motifs FROM z WHERE r = 1""")
def motif_combination(spark, d):
    return motifs.combine(_motif_hits(spark, d)).withColumn("total_score", F.round("total_score", 6))


@query("SELECT cast(user_id AS VARCHAR) AS query_name, " + ", ".join(f"max(value) FILTER (event_id % 4 = {k}) AS \"{t}\"" for k, t in enumerate("ABCD")) + " FROM events GROUP BY 1")
def motif_summary(spark, d):
    return motifs.summary(_motif_hits(spark, d), nested=False)
