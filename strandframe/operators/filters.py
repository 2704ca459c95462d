"""Filters, header operations and schema shaping."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TERM = re.compile(r"\s*([A-Za-z_][\w.]*)\s*(>=|<=|==|!=|>|<)\s*(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*")
_COMPARE = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt, "==": operator.eq, "!=": operator.ne}


def parse_filter(text: str) -> Column:
    """``[a >= 100 & b < 50 | c == 1]``, read from left to right without precedence."""
    body = text.strip().removeprefix("[").removesuffix("]")
    found, at, join = None, 0, "&"
    while True:
        m = _TERM.match(body, at)
        if not m:
            raise ValueError(f"cannot read {body[at:]!r}")
        term = _COMPARE[m[2]](F.col(m[1]), F.lit(float(m[3])))
        found = term if found is None else (found & term if join == "&" else found | term)
        at = m.end()
        if at == len(body):
            return found
        join, at = body[at], at + 1
        if join not in "&|":
            raise ValueError(f"cannot read {body[at - 1 :]!r}")


def exclude_hits(sequences: DataFrame, hits: DataFrame, key: str, hit_key: str, rules: list[str]) -> DataFrame:
    """Sequences without a hit that meets any of the rules."""
    bad = hits.where(reduce(operator.or_, map(parse_filter, rules))).select(F.col(hit_key).alias(key)).distinct()
    return sequences.join(bad, key, "left_anti")


def length_range(df: DataFrame, column: str, least: int | None = None, most: int | None = None) -> DataFrame:
    """Inclusive byte length limits; 0 or None is no limit."""
    n = F.octet_length(column)
    for bound, test in ((least, n >= (least or 0)), (most, n <= (most or 0))):
        df = df.where(test) if bound else df
    return df


def header_filter(df: DataFrame, header: str, wanted: DataFrame, substring: bool = False, invert: bool = False) -> DataFrame:
    """Rows whose header is among (or contains one of) the values of the one-column frame ``wanted``."""
    kind = "left_anti" if invert else "left_semi"
    name = wanted.columns[0]
    other = wanted.select(F.col(name).alias("_wanted")).distinct()
    if substring:
        patterns = [r[0] for r in other.orderBy("_wanted").limit(10_001).collect()]
        if len(patterns) > 10_000:
            raise ValueError("more than 10,000 substrings: match them by a join on a key instead")
        found = F.exists(F.array(*map(F.lit, patterns)), lambda p: F.contains(F.col(header), p)) if patterns else F.lit(False)
        return df.where(~found if invert else found)
    return df.join(other, df[header] == other["_wanted"], kind)


def clean_header(header: Column, prefix: str = "", suffix: str = "", first_word: bool = False) -> Column:
    out = F.regexp_replace(header, "^" + re.escape(prefix), "") if prefix else header
    out = F.regexp_replace(out, re.escape(suffix) + "$", "") if suffix else out
    return F.substring_index(out, " ", 1) if first_word else out


# ---- schemas --------------------------------------------------------------

# Names by which tools call the same column.
ALIASES = {
    "begin": "start", "from": "start", "seq_from": "start", "query_start": "start", "qstart": "start",
    "to": "end", "seq_to": "end", "query_end": "end", "qend": "end",
    "qseqid": "sequence_id", "sequence_ID": "sequence_id", "contig_id": "sequence_id", "contig": "sequence_id", "query": "sequence_id", "id": "sequence_id", "name": "sequence_id",
    "bitscore": "score", "bit_score": "score", "bits": "score",
    "e_value": "evalue",
    "tool": "source", "method": "source", "db": "source", "database": "source",
    "feature": "type", "annotation": "type", "category": "type",
}
STARTS = ("q1", "start", "qstart", "start_pos", "ali_from")
ENDS = ("q2", "end", "qend", "end_pos", "ali_to")
MINIMAL = {"sequence_id": ("string", ""), "type": ("string", ""), "start": ("bigint", 0), "end": ("bigint", 0), "score": ("double", 0.0), "source": ("string", ""), "strand": ("string", "+"), "phase": ("string", ".")}
UNIFIED = MINIMAL | {"source": ("string", "unknown"), "profile_name": ("string", ""), "evalue": ("double", 1.0), "ribozyme_description": ("string", ""), "tRNA_type": ("string", ""), "anticodon": ("string", ""), "motif_type": ("string", ""), "structure": ("string", ""), "sequence": ("string", "")}
GFF_DEFAULTS = {"source": "rp", "type": "feature", "score": "0", "strand": "+", "phase": ".", "start": "0", "end": "1"}


def coordinate_columns(columns: list[str]) -> tuple[str, str]:
    """The first known names of start and end."""
    pick = lambda names: next((n for n in names if n in columns), None)
    start, end = pick(STARTS), pick(ENDS)
    if not start or not end:
        raise ValueError(f"no coordinates among {columns}")
    return start, end


def normalize_names(df: DataFrame) -> DataFrame:
    """Renames known aliases; a target name that is there already, or was given away, stays."""
    taken, names = set(df.columns), {}
    for c in df.columns:
        new = ALIASES.get(c)
        if new and new not in taken:
            names[c] = new
            taken.add(new)
    return df.withColumnsRenamed(names)


def to_schema(df: DataFrame, shape: dict[str, tuple[str, object]]) -> DataFrame:
    """Exactly the columns of ``shape``, cast, with its defaults for what is missing or null."""
    have = set(df.columns)
    return df.select(*[(F.coalesce(F.expr(f"try_cast(`{c}` as {kind})"), F.lit(default).cast(kind)) if c in have else F.lit(default).cast(kind)).alias(c) for c, (kind, default) in shape.items()])


def unify(frames: dict[str, DataFrame]) -> DataFrame:
    """All frames in the unified annotation schema; a frame without ``type`` gets its own name."""
    padded = [to_schema(f if "type" in f.columns else f.withColumn("type", F.lit(name)), UNIFIED) for name, f in ((n, normalize_names(f)) for n, f in frames.items())]
    return reduce(DataFrame.unionByName, padded)


def with_gff_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(v) for c, v in GFF_DEFAULTS.items() if c not in df.columns})


def stack_like(first: DataFrame, second: DataFrame) -> DataFrame:
    """Second in the order and types of first, below it; values that do not cast become null."""
    have = set(second.columns)
    return first.unionByName(second.select(*[(F.expr(f"try_cast(`{f.name}` as {f.dataType.simpleString()})") if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in first.schema.fields]))


def flatten_structs(df: DataFrame, separator: str = ":", depth: int | None = None, keep: bool = False) -> DataFrame:
    """Struct fields as columns ``outer:inner``; a name that clashes is an error."""

    def walk(kind: T.DataType, name: str, value: Column, left: int | None) -> list[tuple[str, Column]]:
        if isinstance(kind, T.StructType) and (left is None or left > 0):
            inner = [x for f in kind.fields for x in walk(f.dataType, f"{name}{separator}{f.name}", value[f.name], None if left is None else left - 1)]
            return [(name, value), *inner] if keep else inner
        return [(name, value)]

    columns = [x for f in df.schema.fields for x in walk(f.dataType, f.name, df[f"`{f.name}`"], depth)]
    names = [n for n, _ in columns]
    if len(set(names)) < len(names):
        raise ValueError(f"columns clash: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return df.select(*[c.alias(n) for n, c in columns])


def nested_to_text(df: DataFrame, separator: str = ",") -> DataFrame:
    """Arrays of scalars joined; structs, maps and deeper arrays as JSON."""

    def text(f: T.StructField) -> Column:
        if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StructType, T.ArrayType, T.MapType)):
            return F.concat_ws(separator, F.transform(f.name, lambda x: x.cast("string")))
        return F.to_json(f.name) if isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType)) else F.col(f.name)

    return df.select(*[text(f).alias(f.name) for f in df.schema.fields])


def enrich(annotations: DataFrame, info: DataFrame, key: str, info_key: str, columns: list[str], prefix: str = "info_") -> DataFrame:
    """Chosen columns of an info table, prefixed, joined from the left on a trimmed key; the first row of a key counts."""
    order = [F.col(c) for c in columns]
    small = info.select(F.trim(info_key).alias("_key"), *columns).groupBy("_key").agg(F.min(F.struct(*order)).alias("_row"))
    return annotations.join(small, F.trim(annotations[key]) == small["_key"], "left").select(annotations["*"], *[F.col(f"_row.{c}").alias(prefix + c) for c in columns])


def pick_first(df: DataFrame, names: list[str]) -> Column:
    """The first of the named columns that the frame has, passing over nulls."""
    have = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


ACCESSIONS = ["target_accession", "accession", "sseqid", "target_name", "db"]


def provenance(query: Column) -> dict[str, Column]:
    """What a translated query's name tells: source sequence, frame and open reading frame."""
    some = lambda pattern: F.nullif(F.regexp_extract(query, pattern, 1), F.lit(""))
    return {"source_seq_id": some(r"^(.+?)(?:_frame|_ORF|\.p|$)"), "frame_id": some(r"frame[=_]?(-?\d)"), "orf_id": some(r"(?i)orf[=_.]?(\d+)")}


def sample_id(name: Column) -> Column:
    """Text before the first underscore."""
    return F.substring_index(name, "_", 1)


def keyword_filter(df: DataFrame, column: str, words: list[str], invert: bool = False) -> DataFrame:
    found = F.coalesce(F.col(column).rlike("(?i)" + "|".join(map(re.escape, words))), F.lit(False))
    return df.where(~found if invert else found)


def replace_rows(base: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Base with the rows of the keys of ``fresh`` replaced by it."""
    return base.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def fill_from(base: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Nulls of ``columns`` filled from another table by key."""
    side = other.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns]).dropDuplicates(keys)
    joined = base.join(side, keys, "left")
    return joined.select(*[F.coalesce(c, f"_{c}").alias(c) if c in columns else c for c in base.columns])
