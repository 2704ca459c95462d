"""Dataset statistics, deduplication, renaming, sampling and ranking."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as sq
from ..session import materialize


def fastx_calc(df: DataFrame, header: str, seq: str, quality: str | None = None, circular: bool = False, least: int = 0, most: int = 0) -> DataFrame:
    """Per sequence: length, gc_content, n_count, hash (of the least rotation where circular)."""
    from .filters import length_range

    kept = length_range(df, seq, least, most)
    key = sq.least_rotation(seq) if circular else F.col(seq)
    columns = [F.col(header).alias("header"), sq.seq_length(F.col(seq)).cast("long").alias("length"), sq.gc_content(F.col(seq)).alias("gc_content"), sq.n_count(F.col(seq)).cast("long").alias("n_count"), sq.hash_prefix(key).alias("hash")]
    return kept.select(*columns, *([sq.avg_quality(F.col(quality)).alias("avg_quality")] if quality else []))


def fastx_stats(calc: DataFrame) -> DataFrame:
    """One row of statistics over the result of ``fastx_calc``."""
    five = lambda c, name: [F.min(c).alias(f"min_{name}"), F.max(c).alias(f"max_{name}"), F.avg(c).alias(f"mean_{name}"), F.median(c).alias(f"median_{name}"), F.stddev_samp(c).alias(f"std_{name}")]
    wanted = [*five("length", "length"), F.sum("length").alias("total_length"), *five("gc_content", "gc"), F.min("n_count").alias("min_n"), F.max("n_count").alias("max_n"), F.avg("n_count").alias("mean_n"), F.sum("n_count").alias("total_n"), F.count(F.lit(1)).alias("total_sequences")]
    return calc.agg(*wanted, *(five("avg_quality", "avg_quality") if "avg_quality" in calc.columns else []))


def markdown_report(stats: DataFrame) -> str:
    """The one row of statistics as a table; floats with two digits."""
    row = stats.first().asDict()
    return "\n".join(["| statistic | value |", "| --- | --- |", *(f"| {k} | {v:.2f} |" if isinstance(v, float) else f"| {k} | {v} |" for k, v in row.items())]) + "\n"


# ---- duplicates -----------------------------------------------------------


def dedup_key(by: str, name: str, seq: str, ignore_case: bool = False, revcomp: bool = False) -> Column:
    key = {"id": F.substring_index(name, " ", 1), "name": F.col(name), "seq": F.col(seq)}[by]
    if revcomp and by == "seq":
        return sq.least_strand(key)
    return F.upper(key) if ignore_case else key


def deduplicate(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """The first row of each key in this order, one of those that tie; null and empty keys are one.

    Keys are long sequences, so only a digest is shuffled with the order
    columns; the rows that stay are chosen by a pre-aggregated minimum, which
    one very frequent key cannot hurt, and not by a window over its group.
    """
    digest = F.sha2(F.coalesce(key, F.lit("")), 256)
    keyed = df.withColumn("_key", digest)
    best = keyed.select("_key", F.struct(*order).alias("_order")).groupBy("_key").agg(F.min("_order").alias("_order"))
    kept = best.select(F.col("_key").alias("_kept"), *[F.col(f"_order.{c}").alias(f"_kept_{c}") for c in order])
    # null-safe on the key too, though no digest is null: a plain equality adds a filter on the scan that computes the digest twice
    same = reduce(operator.and_, [keyed[c].eqNullSafe(kept[f"_kept_{c}"]) for c in order], keyed["_key"].eqNullSafe(kept["_kept"]))
    # rows that the order does not tell apart lie in one partition after the join; one of them stays
    return keyed.join(kept, same, "left_semi").dropDuplicates(["_key", *order]).drop("_key")


def duplicate_groups(df: DataFrame, key: Column, id_: str) -> DataFrame:
    """Keys that occur more than once: digest, count and the ids in order."""
    return df.select(F.md5(F.coalesce(key, F.lit(""))).alias("hash"), F.col(id_).alias("id")).groupBy("hash").agg(F.count(F.lit(1)).alias("count"), F.array_sort(F.collect_list("id")).alias("ids")).where("count > 1")


def duplicate_ids(df: DataFrame, id_: str) -> DataFrame:
    return df.groupBy(id_).count().where("count > 1")


# ---- names ----------------------------------------------------------------


def number_rows(df: DataFrame, order: list[Column], name: str = "_n") -> tuple[DataFrame, int]:
    """``df`` with the running number (from 1) of each row in this order, and the number of rows.

    Numbers are dense over range partitions: each partition counts its rows, and
    the offsets of partitions (one number each) are added, so no single task
    sees all rows. Rows that the order does not tell apart are numbered in any order.
    """
    placed = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = {r["_part"]: r["count"] for r in placed.groupBy("_part").count().collect()}
    total, offsets = 0, []
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    base = df.sparkSession.createDataFrame(offsets, "_part int, _base long")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn(name, local).join(F.broadcast(base), "_part").withColumn(name, F.col(name) + F.col("_base")).drop("_part", "_base"), total


def rename_numbered(df: DataFrame, id_: str, order: list[str], prefix: str = "CID") -> DataFrame:
    """old_id and new_id: prefix and running number, padded to the digits of the row count."""
    keys = [f"_o{k}" for k in range(len(order))]
    sorted_ = df.select(F.col(id_).alias("old_id"), *[F.col(c).alias(k) for k, c in zip(keys, order, strict=True)])
    numbered, total = number_rows(sorted_, [F.col(c) for c in (*keys, "old_id")])
    return numbered.select("old_id", F.concat(F.lit(prefix), F.lpad(F.col("_n").cast("string"), len(str(max(total, 1))), "0")).alias("new_id"))


def rename_hashed(df: DataFrame, id_: str, seq: str, prefix: str = "CID") -> DataFrame:
    return df.select(F.col(id_).alias("old_id"), F.concat(F.lit(f"{prefix}_"), F.md5(seq)).alias("new_id"))


# ---- samples --------------------------------------------------------------


def first_reads(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n records in file order, n made even for interleaved pairs."""
    return df.orderBy(order).limit(n - n % 2)


def random_reads(df: DataFrame, id_: str, n: int | None = None, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """n records, or about a fraction of them, chosen by a hash of id and seed."""
    luck = F.md5(F.concat_ws(":", F.col(id_).cast("string"), F.lit(str(seed))))
    if n is not None:
        return df.withColumn("_luck", luck).orderBy("_luck", id_).limit(n - n % 2).drop("_luck")
    share = F.conv(F.left(luck, F.lit(8)), 16, 10).cast("long") / F.lit(float(1 << 32))
    return df.where(share < fraction)


def read_key(header: Column) -> Column:
    """What both mates of a pair share of their headers."""
    return F.regexp_replace(F.substring_index(header, " ", 1), r"[/._][12]$", "")


def paired_sample(r1: DataFrame, r2: DataFrame, header: str, **how: object) -> tuple[DataFrame, DataFrame]:
    """A sample of the first mates, and the second mates that belong to it."""
    one = random_reads(r1, header, **how)
    return one, r2.withColumn("_pair", read_key(F.col(header))).join(one.select(read_key(F.col(header)).alias("_pair")), "_pair", "left_semi").drop("_pair")


def stratified_sample(df: DataFrame, stratum: str, id_: str, target: int, seed: int = 42) -> DataFrame:
    """About ``target`` rows in proportion to the strata, each with one row at least."""
    luck = F.md5(F.concat_ws(":", F.col(id_).cast("string"), F.lit(str(seed))))
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    quota = F.greatest(F.lit(1), F.floor(F.col("_n") * target / F.sum("_n").over(Window.partitionBy(F.lit(1)))))
    share = sizes.select(stratum, quota.cast("int").alias("_quota"))
    # only rows whose hash is below twice the share of the stratum (and a little more) are ranked; a
    # stratum of which too few are left, by bad luck, is ranked whole, so the sample is the same
    sized = df.withColumn("_luck", luck).join(sizes.join(share, stratum), stratum)
    low = F.conv(F.left("_luck", F.lit(8)), 16, 10).cast("long") / F.lit(float(1 << 32)) < F.col("_quota") * 2.0 / F.col("_n") + 64.0 / F.col("_n")
    enough = sized.where(low).groupBy(stratum).agg(F.count(F.lit(1)).alias("_have"))
    some = sized.join(enough, stratum, "left").where(low | (F.coalesce("_have", F.lit(0)) < F.col("_quota")))
    ranked = some.withColumn("_rank", F.row_number().over(Window.partitionBy(stratum).orderBy("_luck", id_)))
    return ranked.where("_rank <= _quota").select(*df.columns)


def best_record(df: DataFrame, key: str, priority: list[tuple[str, bool]], tie: str) -> DataFrame:
    """The best row of each key: columns in order of priority, descending where True, nulls last."""
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in priority]
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order, tie))).where("_rank = 1").drop("_rank")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).count().orderBy(F.desc("count"), column)


def last_by(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def histogram_total(df: DataFrame, length: str, count: str) -> DataFrame:
    return df.agg(F.sum(F.col(length) * F.col(count)).alias("total_bases"), F.sum(count).alias("total_reads"))


def fastq_layout(df: DataFrame, header: str = "header", n: int = 1000) -> DataFrame:
    """Suffix counts and the layout of the first n records: interleaved, paired_R1, paired_R2 or single."""
    head = df.limit(n).select(F.substring_index(header, " ", 1).alias("h"), F.regexp_extract(header, r" ([12]):", 1).alias("casava"), read_key(F.col(header)).alias("key"))
    mate = F.when(F.col("casava") != "", F.col("casava")).when(F.col("h").rlike(r"[/._]1$"), "1").when(F.col("h").rlike(r"[/._]2$"), "2")
    counts = head.select(mate.alias("m"), "key").agg(F.count_if(F.col("m") == "1").alias("first"), F.count_if(F.col("m") == "2").alias("second"), F.size(F.array_intersect(F.collect_set(F.when(F.col("m") == "1", F.col("key"))), F.collect_set(F.when(F.col("m") == "2", F.col("key"))))).alias("shared"))
    layout = F.when((F.col("first") > 0) & (F.col("second") > 0) & (F.col("shared") > 0), "interleaved").when(F.col("first") > F.col("second"), "paired_R1").when(F.col("second") > 0, "paired_R2").otherwise("single")
    return counts.withColumn("layout", layout)
