"""Column -> Column functions over nucleotide and protein strings.

All are built-in expressions but for ``least_strand``, ``translate`` and ``codon_usage``, which
work on Arrow batches: as expressions they take ten times as long.
``length`` is in bytes and fractions are over characters, which only differs
on text that is not ASCII.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Complement of the IUPAC nucleotide codes (U reads as T's partner).
IUPAC, IUPAC_COMPLEMENT = "ACGTURYSWKMBDHVN", "TGCAAYRSWMKVHDBN"


def gc_content(seq: Column) -> Column:
    return F.try_divide(F.regexp_count(seq, F.lit("[GgCc]")), F.char_length(seq))


def gc_upper(seq: Column) -> Column:
    """GC fraction where only upper-case letters count."""
    return F.try_divide(F.regexp_count(seq, F.lit("[GC]")), F.char_length(seq))


def n_count(seq: Column) -> Column:
    return F.regexp_count(seq, F.lit("[Nn]"))


def seq_length(seq: Column) -> Column:
    return F.octet_length(seq)


def hash_prefix(seq: Column, n: int = 32) -> Column:
    return F.left(F.md5(seq), F.lit(n))


def upper_ascii(seq: Column) -> Column:
    """a-z in upper case; unlike a full case mapping it never changes the length.

    ASCII text takes the full mapping, which is the same for it and much faster than a translation.
    """
    plain = F.octet_length(seq) == F.char_length(seq)
    return F.when(plain, F.upper(seq)).otherwise(F.translate(seq, string.ascii_lowercase, string.ascii_uppercase))


def letters(seq: Column) -> Column:
    """Array of characters; empty for the empty string."""
    return F.filter(F.split(seq, ""), lambda c: c != "")


def avg_quality(quality: Column, base: int = 33) -> Column:
    """Mean Phred score of a quality string; null for the empty string."""
    total = F.aggregate(F.transform(letters(quality), lambda c: F.ascii(c) - base), F.lit(0), lambda a, x: a + x)
    return F.try_divide(total, F.char_length(quality))


def revcomp(seq: Column) -> Column:
    """Reverse complement of upper-case IUPAC letters; other letters stay."""
    return F.translate(F.reverse(seq), IUPAC, IUPAC_COMPLEMENT)


_UPPER = bytes.maketrans(string.ascii_lowercase.encode(), string.ascii_uppercase.encode())
_TURN = _UPPER.translate(bytes.maketrans(IUPAC.encode(), IUPAC_COMPLEMENT.encode()))


@F.pandas_udf(T.StringType())
def least_strand(seqs: pd.Series) -> pd.Series:
    """The lesser of a sequence (a-z as A-Z) and its reverse complement, by code points.

    Only ASCII letters change, so both strands are mapped as UTF-8 bytes, whose order is that of the code points.
    """
    least = lambda s: min(s.encode().translate(_UPPER), s[::-1].encode().translate(_TURN)).decode()
    return pd.Series([None if s is None else least(s) for s in seqs], dtype=object)


def canonical_kmer(kmer: Column) -> Column:
    return F.least(kmer, F.translate(F.reverse(kmer), "ACGT", "TGCA"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once: a lambda variable instead of
    an expression that each element of an inner loop would evaluate again."""
    return F.transform(F.array(value), body)[0]


def kmers(seq: Column, k: int, skip_ambiguous: bool = False) -> Column:
    """All windows of k characters, an empty array where there is none.

    Windows are slices of the array of characters, so the time is linear.
    """
    window = lambda chars: F.transform(F.sequence(F.lit(1), F.greatest(F.size(chars) - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(chars, i, k), ""))
    windows = F.when(F.char_length(seq) >= k, _bound(letters(seq), window)).otherwise(F.array().cast("array<string>"))
    return F.filter(windows, lambda w: w.rlike("^[ACGT]+$")) if skip_ambiguous else windows


def codons(seq: Column) -> Column:
    """The whole codons of frame 1."""
    return F.regexp_extract_all(seq, F.lit("(?s)..."), F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    """Differing positions; null unless both have one length."""
    unequal = F.filter(F.zip_with(letters(a), letters(b), lambda x, y: x != y), lambda d: d)
    return F.when(F.char_length(a) == F.char_length(b), F.size(unequal))


def identity_at(a: Column, b: Column) -> Column:
    """Share of equal characters over the shorter length; 0 where that is 0."""
    n = F.least(F.char_length(a), F.char_length(b))
    equal = F.filter(F.zip_with(letters(F.substr(a, F.lit(1), n)), letters(F.substr(b, F.lit(1), n)), lambda x, y: x == y), lambda d: d)
    return F.coalesce(F.try_divide(F.size(equal), n), F.lit(0.0))


def terminal_identity(a: Column, b: Column, edge: int = 30) -> Column:
    """The lesser identity of both ends."""
    n = F.least(F.char_length(a), F.char_length(b), F.lit(edge))
    head = identity_at(F.substr(a, F.lit(1), n), F.substr(b, F.lit(1), n))
    tail = identity_at(F.right(a, n), F.right(b, n))
    return F.least(head, tail)


def _cigar_sum(cigar: Column, ops: str) -> Column:
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(f"(\\d+)[{ops}]"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def cigar_identity(cigar: Column, nm: Column) -> Column:
    """Percent identity from CIGAR and edit distance."""
    return F.try_divide((_cigar_sum(cigar, "M=X") - nm) * 100.0, _cigar_sum(cigar, "MIDX="))


def cigar_reference_length(cigar: Column) -> Column:
    return _cigar_sum(cigar, "MDN=X")


# ---- alphabet -------------------------------------------------------------


def is_nucleotide(seq: Column) -> Column:
    return F.upper(seq).rlike("^[ATGCUN]*$")


def is_protein(seq: Column) -> Column:
    return F.upper(seq).rlike(r"^[ACDEFGHIKLMNPQRSTVWYXBZJUO*\-]*$")


def guess_alphabet(seq: Column) -> Column:
    return F.when(is_nucleotide(seq), "nucl").when(is_protein(seq), "amino").otherwise("unknown")


# ---- translation ----------------------------------------------------------

BASES = "TCAG"
# The standard genetic code in TCAG order, then how the other
# NCBI tables differ from it, and the start codons of each table.
STANDARD = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
DIFFERENCES = {
    1: {},
    2: {"AGA": "*", "AGG": "*", "ATA": "M", "TGA": "W"},
    3: {"ATA": "M", "CTT": "T", "CTC": "T", "CTA": "T", "CTG": "T", "TGA": "W"},
    4: {"TGA": "W"},
    5: {"AGA": "S", "AGG": "S", "ATA": "M", "TGA": "W"},
    6: {"TAA": "Q", "TAG": "Q"},
    9: {"AAA": "N", "AGA": "S", "AGG": "S", "TGA": "W"},
    10: {"TGA": "C"},
    11: {},
    12: {"CTG": "S"},
    13: {"AGA": "G", "AGG": "G", "ATA": "M", "TGA": "W"},
    14: {"AAA": "N", "AGA": "S", "AGG": "S", "TAA": "Y", "TGA": "W"},
    15: {"TAG": "Q"},
    16: {"TAG": "L"},
    21: {"TGA": "W", "ATA": "M", "AGA": "S", "AGG": "S", "AAA": "N"},
    22: {"TCA": "*", "TAG": "L"},
    23: {"TTA": "*"},
    24: {"AGA": "S", "AGG": "K", "TGA": "W"},
    25: {"TGA": "G"},
    26: {"CTG": "A"},
    27: {"TAA": "Q", "TAG": "Q", "TGA": "W"},
    28: {"TAA": "Q", "TAG": "Q", "TGA": "W"},
    29: {"TAA": "Y", "TAG": "Y"},
    30: {"TAA": "E", "TAG": "E"},
    31: {"TAA": "E", "TAG": "E", "TGA": "W"},
    32: {"TAG": "W"},
    33: {"TAA": "Y", "AGA": "S", "AGG": "K", "TGA": "W"},
    # generic codes by their stops, which are not NCBI's
    666: {"TAA": "1", "TAG": "2", "TGA": "3"},
    6000: {"TAA": "Q", "TAG": "Q", "TGA": "W"},
    7001: {"TAG": "Q", "TGA": "W"},
    7010: {"TAA": "Q", "TGA": "W"},
    7100: {"TAA": "Q", "TAG": "Q"},
    8011: {"TGA": "W"},
    8101: {"TAG": "Q"},
    8110: {"TAA": "Q"},
    9111: {},
}
STARTS = {
    1: ["TTG", "CTG", "ATG"],
    2: ["ATT", "ATC", "ATA", "ATG", "GTG"],
    3: ["ATA", "ATG", "GTG"],
    4: ["TTA", "TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG"],
    5: ["TTG", "ATT", "ATC", "ATA", "ATG", "GTG"],
    9: ["ATG", "GTG"],
    11: ["TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG"],
    12: ["CTG", "ATG"],
    13: ["TTG", "ATA", "ATG", "GTG"],
    21: ["ATG", "GTG"],
    23: ["ATT", "ATG", "GTG"],
    24: ["TTG", "CTG", "ATG", "GTG"],
    25: ["TTG", "ATG", "GTG"],
    26: ["CTG", "ATG"],
    33: ["TTG", "CTG", "ATG", "GTG"],
    666: ["TTG", "CTG", "ATG"],
    **dict.fromkeys((6000, 7001, 7010, 7100, 8011, 8101, 8110, 9111), ["TTG", "CTG", "ATT", "ATC", "ATA", "ATG", "GTG"]),
}


def translation_table(code: int = 1, mark_starts: bool = True) -> dict[str, str]:
    """Codon to amino acid; start codons in lower case where marked."""
    if code not in DIFFERENCES:
        raise ValueError(f"unknown genetic code {code}")
    codons = [a + b + c for a in BASES for b in BASES for c in BASES]
    table = dict(zip(codons, STANDARD, strict=True)) | DIFFERENCES[code]
    for codon in STARTS.get(code, ["ATG"]) if mark_starts else []:
        table[codon] = table[codon].lower()
    return table


# Letters as digits: T (U), C, A, G are 0 to 3, so that a complement is an exclusive or with 2; a gap is 4, all else 5.
_GAP, _OTHER = 4, 5
_DIGIT = bytes(next((d for d, of in enumerate(("TtUu", "Cc", "Aa", "Gg", "-")) if chr(b) in of), _OTHER) for b in range(256))
_DROPPED = b" \t\n\x0b\f\r" + bytes(range(0x80, 0xC0))
_COMPLEMENT_DIGIT = np.array([2, 3, 0, 1, _GAP, _OTHER], np.uint8)


def translate(seq: Column, frame: int = 1, code: int = 1, mark_starts: bool = True) -> Column:
    """Protein of one frame (1..3, or -1..-3 on the reverse complement).

    White space goes and U becomes T; a-z become A-Z, so other letters keep their place; an
    unknown codon is X, one of three gaps a gap; the tail is dropped.
    """
    if frame not in (1, 2, 3, -1, -2, -3):
        raise ValueError(f"no frame {frame}")
    proteins = np.full(216, ord("X"), np.uint8)
    for codon, protein in (translation_table(code, mark_starts) | {"---": "-"}).items():
        a, b, c = codon.encode().translate(_DIGIT)
        proteins[36 * a + 6 * b + c] = ord(protein)

    return _protein(proteins, frame)(seq)


def _protein(proteins: np.ndarray, frame: int) -> Callable[[Column], Column]:
    def of(text: bytes) -> bytes:
        # of each code point beyond ASCII the first byte stays, which is no base
        digits = np.frombuffer(text.translate(_DIGIT, _DROPPED), np.uint8)
        strand = (digits if frame > 0 else _COMPLEMENT_DIGIT[digits[::-1]])[abs(frame) - 1 :]
        whole = len(strand) - len(strand) % 3
        at = strand[:whole:3] * np.uint8(36)  # 215 at most
        at += strand[1:whole:3] * np.uint8(6)
        at += strand[2:whole:3]
        return proteins[at].tobytes()

    @F.arrow_udf(T.StringType())
    def translated(seqs: pa.Array) -> pa.Array:
        # bytes of the batch's buffer, text by text: no text is copied but the one at work, and proteins are bytes until the end
        texts = seqs.cast(pa.large_binary())
        out, ends = bytearray(), [0]
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
        data = memoryview(texts.buffers()[2] or b"")
        for a, b in zip(offsets, offsets[1:], strict=False):
            out += of(bytes(data[a:b]))
            ends.append(len(out))
        known = pa.array(np.asarray(texts.is_valid())) if texts.null_count else None
        made = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.array(ends, np.int64)), pa.py_buffer(out), known.buffers()[1] if known is not None else None)
        return made.cast(pa.string())

    return translated


FRAMES = (1, 2, 3, -1, -2, -3)


def six_frames(seq: Column, code: int = 1, mark_starts: bool = True) -> Column:
    """Array of (frame, protein) over all six frames."""
    return F.array(*[F.struct(F.lit(f).alias("frame"), translate(seq, f, code, mark_starts).alias("protein")) for f in FRAMES])


def orfs(protein: Column, mode: int = 1, least: int = 16) -> Column:
    """Open reading frames of a translated frame as (start, protein), start in amino acids from 0.

    Mode 0 is the whole frame, 1 from stop to stop, 2 from the first start (lower case) on.
    """
    if mode == 0:
        return F.array(F.struct(F.lit(0).alias("start"), protein.alias("protein")))
    parts = F.split(protein, r"\*", -1)
    step = lambda acc, x: F.struct((acc["at"] + F.char_length(x) + 1).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), x.alias("protein")))).alias("out"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,protein:string>>").alias("out"))
    pieces = F.aggregate(parts, zero, step)["out"]
    if mode == 2:
        head = lambda x: F.char_length(F.regexp_extract(x["protein"], "^([^a-z]*)", 1))
        pieces = F.transform(pieces, lambda x: F.struct((x["start"] + head(x)).alias("start"), F.substr(x["protein"], head(x) + 1).alias("protein")))
    elif mode != 1:
        raise ValueError(f"no ORF mode {mode}")
    return F.filter(pieces, lambda x: F.char_length(x["protein"]) >= least)


def codon_usage(seq: Column) -> Column:
    """Map from codon to its share in frame 1; codons with N are left out."""
    return _codon_shares(upper_ascii(seq))


@F.arrow_udf(T.MapType(T.StringType(), T.DoubleType()))
def _codon_shares(seqs: pa.Array) -> pa.Array:
    return pa.concat_arrays([_shares_of(seqs.slice(k, 500)) for k in range(0, max(len(seqs), 1), 500)])


def _shares_of(seqs: pa.Array) -> pa.Array:
    """Codons of each text as numbers of three code points, counted by sorting."""
    words, shares, sizes = [], [], []
    for text in seqs:
        points = np.frombuffer((text.as_py() or "").encode("utf-32-le"), "<u4")
        points = points[: len(points) - len(points) % 3].reshape(-1, 3)
        points = points[(points != ord("N")).all(1)].astype(np.int64)
        found, times = np.unique((points[:, 0] << 42) | (points[:, 1] << 21) | points[:, 2], return_counts=True)
        words.append(found)
        shares.append(times / max(len(points), 1))
        sizes.append(len(found) if text.is_valid else None)
    # each distinct codon of the batch becomes a string once
    distinct, back = np.unique(np.concatenate(words) if words else np.zeros(0, np.int64), return_inverse=True)
    letters_ = np.stack([distinct >> 42, distinct >> 21 & 0x1FFFFF, distinct & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le")
    names = pa.array([letters_[k : k + 3] for k in range(0, len(letters_), 3)], pa.string()).take(pa.array(back))
    ends = np.concatenate([[0], np.cumsum([n or 0 for n in sizes])])
    offsets = pa.array(ends.astype(np.int32), mask=np.array([n is None for n in sizes] + [False]))
    return pa.MapArray.from_arrays(offsets, names, pa.array(np.concatenate(shares) if shares else np.zeros(0)))


# ---- masks and slices -----------------------------------------------------


def mask_range(seq: Column, start: Column, end: Column) -> Column:
    """N over the half-open range [start, end) counted from 0; the range is cut to the sequence."""
    n = F.char_length(seq)
    s, e = F.greatest(F.least(start, n), F.lit(0)).cast("int"), F.greatest(F.least(end, n), F.lit(0)).cast("int")
    return F.when(e > s, F.concat(F.substr(seq, F.lit(1), s), F.repeat(F.lit("N"), e - s), F.substr(seq, e + 1))).otherwise(seq)


def mask_ranges(seq: Column, ranges: Column) -> Column:
    """Masks every (start, end) of an array."""
    return F.aggregate(ranges, seq, lambda s, r: mask_range(s, r["start"], r["end"]))


def trim_region(seq: Column, start: Column, end: Column, reverse: Column | None = None) -> Column:
    """Characters [start, end) from 0; their reverse complement where ``reverse`` holds."""
    cut = F.substr(seq, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
    return cut if reverse is None else F.when(reverse, revcomp(cut)).otherwise(cut)


def clipped_containment(long_: Column, short: Column, most: int, both: bool = True) -> Column:
    """Whether the short motif is the long one without 1..most characters at one end, or at both."""
    delta = F.char_length(long_) - F.char_length(short)
    edge = F.endswith(long_, short) | F.startswith(long_, short)
    return delta.between(1, most) & (F.contains(long_, short) if both else edge)


@F.pandas_udf(T.StringType())
def least_rotation(seqs: pd.Series) -> pd.Series:
    """The least cyclic shift, in linear time (no built-in expresses it in less than n*n)."""

    def one(s: str | None) -> str | None:
        if not s:
            return s
        n, i, j, k = len(s), 0, 1, 0
        while i < n and j < n and k < n:
            a, b = s[(i + k) % n], s[(j + k) % n]
            if a == b:
                k += 1
                continue
            if a > b:
                i += k + 1
            else:
                j += k + 1
            if i == j:
                j += 1
            k = 0
        at = min(i, j)
        return s[at:] + s[:at]

    return seqs.map(one)


def track_span(seq: Column, k: int = 9, inverted: bool = False) -> Column:
    """Longest run of matching k-mers on one diagonal off the main one, as a span in characters."""
    return _track(seq, F.lit(k), F.lit(inverted))


@F.pandas_udf(T.IntegerType())
def _track(seqs: pd.Series, ks: pd.Series, inverted: pd.Series) -> pd.Series:
    comp = str.maketrans("ACGT", "TGCA")

    def one(s: str | None, k: int, inv: bool) -> int:
        n = len(s or "") - k + 1
        if n < 1:
            return 0
        at: dict[str, list[int]] = {}
        for i in range(n):
            at.setdefault(s[i : i + k], []).append(i)
        runs: dict[tuple[int, int], int] = {}
        best = 0
        for i in range(n):
            word = s[i : i + k]
            for j in at.get(word.translate(comp)[::-1] if inv else word, ()):
                if not inv and j <= i:
                    continue
                run = runs.get((i - 1, j + 1 if inv else j - 1), 0) + 1
                runs[i, j] = run
                best = max(best, run)
        return best + k - 1 if best else 0

    return pd.Series([one(s, int(k), bool(v)) for s, k, v in zip(seqs, ks, inverted, strict=True)])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
