"""What headers, accessions and settings say in their text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Run, experiment, sample and study accessions of the three archives.
RUN_ACCESSION = r"^[SED]R[RXSP]\d{6,}$"
_UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
_PAIRS = ((r"(.*)_R1([._].*)$", r"\1_R2\2"), (r"(.*)_1([._].*)$", r"\1_2\2"), (r"(.*)\.1(\.f.*q.*)$", r"\1.2\2"))


def memory_bytes(text: str) -> int:
    """``6gb``, ``512 MB`` or ``2.5G`` as bytes; a bare number is bytes."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kmgt]?)i?b?\s*", text.lower())
    if not m:
        raise ValueError(f"no amount of memory: {text!r}")
    return int(float(m[1]) * _UNITS[m[2]])


def mate_file(name: str) -> str | None:
    """The file of second mates that belongs to a file of first mates, by its name; None where the name says nothing."""
    return next((re.sub(pattern, other, name) for pattern, other in _PAIRS if re.match(pattern, name)), None)


def pair_files(names: list[str]) -> tuple[list[tuple[str, str]], list[str]]:
    """Pairs of first and second mates among the names, and the names left over, in order."""
    have = set(names)
    pairs = [(n, mate) for n in sorted(have) if (mate := mate_file(n)) in have and mate != n]
    used = {x for pair in pairs for x in pair}
    return pairs, sorted(have - used)


def header_fields(header: Column, names: tuple[str, ...] = ("taxid", "source", "type", "accession"), separator: str = "@") -> Column:
    """A header's parts between separators as a struct; missing ones are null."""
    parts = F.split(header, re.escape(separator))
    return F.struct(*[F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(names)])


def tagged_numbers(header: Column, tags: tuple[str, ...] = ("c", "s", "p", "i")) -> Column:
    """The numbers after ``c_``, ``s_``, ``p_`` and ``i_`` in a read header as a struct; missing ones are null."""
    number = lambda t: F.regexp_extract(header, rf"(?:^|[^A-Za-z0-9]){t}_(\d+)", 1)
    return F.struct(*[F.nullif(number(t), F.lit("")).cast("long").alias(t) for t in tags])


def is_run_accession(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(RUN_ACCESSION), F.lit(False))


def chain_label(names: Column, strands: Column, overlaps: Column) -> Column:
    """``a> -12- <b``: members of a chain with arrows for their strands and the overlaps between them."""
    shown = F.zip_with(names, strands, lambda n, s: F.when(s == "-", F.concat(F.lit("<"), n)).otherwise(F.concat(n, F.lit(">"))))
    joined = F.zip_with(shown, overlaps, lambda x, o: F.concat_ws(" ", x, F.when(o.isNotNull(), F.concat(F.lit("-"), o.cast("string"), F.lit("-")))))
    return F.array_join(joined, " ")
