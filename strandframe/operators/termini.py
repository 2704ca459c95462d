"""Groups of sequences that share their ends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as sq
from .components import connected_components
from .tables import number_rows


def parse_window(text: str) -> tuple[int, int]:
    """``40`` or ``25-40`` as least and largest length."""
    low, _, high = text.partition("-")
    a, b = int(low), int(high or low)
    if not 0 < a <= b:
        raise ValueError(f"no window: {text!r}")
    return a, b


def found_label(strand: Column, end: Column) -> Column:
    return F.concat(F.when(strand == "+", "fwd").otherwise("rc"), F.lit("_on_"), F.when(end == "5prime", "5").otherwise("3"), F.lit("_end"))


def signatures(df: DataFrame, id_: str, seq: str, least: int, most: int, strand: str = "both") -> DataFrame:
    """Ends of each sequence as motifs of ``least`` characters, with up to ``most`` for later extension.

    On the minus strand, the ends of the reverse complement are turned back
    into reading direction and swap their names. Lengths are in characters.
    """
    if strand not in ("plus", "minus", "both"):
        raise ValueError(f"no strand {strand!r}")
    base = df.select(F.col(id_).alias("contig_id"), F.col(seq).alias("s"), F.char_length(seq).alias("n")).where(F.col("n") >= least)
    # only the ends are turned, and a sequence is read once for all of them
    ends = base.select("contig_id", "n", F.left("s", F.lit(most)).alias("head"), F.right("s", F.lit(most)).alias("tail"))
    parts = []
    for plus in [True] * (strand != "minus") + [False] * (strand != "plus"):
        for end in ("5prime", "3prime"):
            name = end if plus else {"5prime": "3prime", "3prime": "5prime"}[end]
            full = F.col("head" if name == "5prime" else "tail")
            least_part = F.left(full, F.lit(least)) if name == "5prime" else F.right(full, F.lit(least))
            turn = (lambda c: c) if plus else (lambda c: sq.revcomp(sq.revcomp(c)))
            start = F.lit(1).cast("long") if name == "5prime" else (F.col("n") - least + 1).cast("long")
            parts.append(F.struct(F.lit(f"{'+' if plus else '-'}_{end}").alias("terminus"), F.lit(name).alias("end_label"), F.lit("+" if plus else "-").alias("strand_label"), turn(least_part).alias("motif_min"), turn(full).alias("motif_full"), start.alias("motif_start"), (start + least - 1).alias("motif_stop")))
    out = ends.select("contig_id", F.explode(F.array(*parts)).alias("x")).select("contig_id", "x.*")
    return out.where("motif_min is not null and motif_min <> ''").withColumn("found_in", found_label(F.col("strand_label"), F.col("end_label")))


def one_per_end(sig: DataFrame) -> DataFrame:
    """One signature for each sequence and end, the plus strand first."""
    w = Window.partitionBy("contig_id", "end_label").orderBy(F.when(F.col("strand_label") == "+", 0).otherwise(1), "terminus")
    return sig.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def exact_groups(sig: DataFrame) -> DataFrame:
    """Motifs of two members or more: motif, member_count, sorted members, found_in and end_label (or mixed)."""
    g = sig.groupBy(F.col("motif_min").alias("motif")).agg(F.count(F.lit(1)).alias("member_count"), F.array_sort(F.collect_set("contig_id")).alias("members"), F.array_sort(F.collect_set("found_in")).alias("found_in"), F.array_sort(F.collect_set("end_label")).alias("ends_present")).where("member_count > 1")
    return g.withColumn("end_label", F.when(F.size("ends_present") == 1, F.col("ends_present")[0]).otherwise("mixed"))


def number_groups(groups: DataFrame) -> DataFrame:
    return number_rows(groups, [F.col("end_label"), F.desc("member_count"), F.col("motif")], "group_id")[0]


def hamming_groups(sig: DataFrame, distance: int) -> DataFrame:
    """Distinct motifs by seeds: in order of frequency, then motif, each joins the
    first seed of its end within ``distance``; groups of two members or more.

    Order decides the result, so one end's distinct motifs go to one task;
    equal motifs are counted before.
    """
    counted = sig.groupBy("end_label", F.col("motif_min").alias("motif")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("contig_id")).alias("members"))

    def seeds(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "motif"], ascending=[False, True])
        found: list[str] = []
        out = []
        for motif in pdf["motif"]:
            seed = next((s for s in found if len(s) == len(motif) and sum(a != b for a, b in zip(s, motif, strict=True)) <= distance), None)
            if seed is None:
                found.append(motif)
                seed = motif
            out.append(seed)
        return pdf.assign(seed=out)[["end_label", "motif", "seed", "n", "members"]]

    seeded = counted.groupBy("end_label").applyInPandas(seeds, "end_label string, motif string, seed string, n long, members array<string>")
    letters = consensus(seeded, ["end_label", "seed"], "motif", "n")
    groups = seeded.groupBy("end_label", "seed").agg(F.sum("n").alias("member_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members")).where("member_count > 1")
    return groups.join(letters, ["end_label", "seed"]).select("end_label", F.col("consensus").alias("motif"), "member_count", "members")


def consensus(df: DataFrame, keys: list[str], motif: str, weight: str | None = None) -> DataFrame:
    """The most frequent character at each position, the smaller one on ties."""
    chars = df.select(*keys, F.posexplode(sq.letters(F.col(motif))).alias("pos", "ch"), (F.col(weight) if weight else F.lit(1)).alias("w"))
    counted = chars.groupBy(*keys, "pos", "ch").agg(F.sum("w").alias("n"))
    top = counted.groupBy(*keys, "pos").agg(F.min(F.struct((-F.col("n")).alias("o"), "ch"))["ch"].alias("ch"))
    return top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "").alias("consensus"))


def extend_motif(sig: DataFrame, keys: list[str]) -> DataFrame:
    """The longest prefix of ``motif_full`` that all members share."""
    chars = sig.select(*keys, "contig_id", F.posexplode(sq.letters(F.col("motif_full"))).alias("pos", "ch"))
    size = sig.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"))
    agree = chars.groupBy(*keys, "pos").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ch").alias("k"), F.min("ch").alias("ch")).join(size, keys).withColumn("bad", ((F.col("k") > 1) | (F.col("n") < F.col("members"))).cast("int"))
    w = Window.partitionBy(*keys).orderBy("pos")
    good = agree.withColumn("_bad", F.sum("bad").over(w)).where("_bad = 0")
    return good.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ch"))), lambda x: x["ch"]), "").alias("motif"))


def collapse_clipped(groups: DataFrame, most: int = 4, mode: str = "both") -> DataFrame:
    """Joins groups whose motif is another's with up to ``most`` characters clipped.

    groups: group_id, motif, members and, if counted apart, member_count (of ends). Clipped forms of a motif are listed and
    matched by equality, so no pair of motifs is compared in vain. The new id
    is the least; the representative has the longest motif, most members, least id.
    """
    n = F.char_length("motif")
    forms = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda a: F.transform(F.sequence(F.lit(0), F.lit(most)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    allowed = (F.col("f.a") + F.col("f.b")).between(1, most) & (F.lit(mode == "both") | (F.col("f.a") == 0) | (F.col("f.b") == 0)) & (F.col("f.a") + F.col("f.b") < n)
    clipped = groups.select("group_id", "motif", F.explode(forms).alias("f")).where(allowed).select("group_id", F.substr("motif", F.col("f.a") + 1, F.char_length("motif") - F.col("f.a") - F.col("f.b")).alias("motif"))
    edges = clipped.join(groups.select(F.col("group_id").alias("other"), "motif"), "motif").select(F.col("group_id").alias("src"), F.col("other").alias("dst")).distinct()
    part = connected_components(edges)
    joined = groups.join(part.select(F.col("id").alias("group_id"), "component"), "group_id", "left").withColumn("component", F.coalesce("component", "group_id"))
    ends = F.col("member_count") if "member_count" in groups.columns else F.size("members").cast("long")
    best = F.min_by("motif", F.struct(-F.char_length("motif"), -ends, F.col("group_id")))
    return joined.groupBy(F.col("component").alias("new_id")).agg(best.alias("motif"), F.array_sort(F.collect_list("group_id")).alias("source_group_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))).alias("members")).withColumnRenamed("new_id", "group_id").withColumn("member_count", F.size("members").cast("long"))


def membership(sequences: DataFrame, id_: str, groups: DataFrame, sig: DataFrame) -> DataFrame:
    """One row for each sequence with the group of its 5' and of its 3' end.

    An end without a group has a negative number of its own: with i counting
    sequences from 1 in order of id, -(2i-1) at the 5' end and -2i at the 3' end.
    """
    placed = sig.select("contig_id", "end_label", F.col("motif_min").alias("motif")).join(groups.select("motif", "group_id"), "motif")
    best = placed.groupBy("contig_id", "end_label").agg(F.min("group_id").alias("g"))
    side = lambda end, name: best.where(F.col("end_label") == end).select("contig_id", F.col("g").alias(name))
    ids = number_rows(sequences.select(F.col(id_).alias("contig_id")).distinct(), [F.col("contig_id")], "i")[0]
    out = ids.join(side("5prime", "g5"), "contig_id", "left").join(side("3prime", "g3"), "contig_id", "left")
    return out.select("contig_id", F.coalesce("g5", -(F.col("i") * 2 - 1)).alias("group_5prime"), F.coalesce("g3", -(F.col("i") * 2)).alias("group_3prime"))


def cluster_longest(sequences: DataFrame, id_: str, length: str, assigned: DataFrame) -> DataFrame:
    """The longest sequence of each cluster, the first by id on ties."""
    j = sequences.join(assigned.select(F.col("seq_id").alias(id_), "cluster_id"), id_)
    return j.withColumn("_r", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc(length), id_))).where("_r = 1").drop("_r", "cluster_id")


def fasta_headers(groups: DataFrame, sig: DataFrame) -> DataFrame:
    """Header and motif of each group, its first member as the example."""
    first = sig.select(F.col("motif_min").alias("motif"), "contig_id", "motif_start", "motif_stop", "end_label").groupBy("motif").agg(F.min(F.struct("contig_id", "motif_start", "motif_stop", "end_label")).alias("x"))
    name = F.format_string("group_id_%d_mems_%d_exmp_%s:%d-%d:%s", "group_id", "member_count", "x.contig_id", "x.motif_start", "x.motif_stop", "x.end_label")
    return groups.select("group_id", "motif", "member_count").join(first, "motif").select(name.alias("header"), F.col("motif").alias("sequence"))
