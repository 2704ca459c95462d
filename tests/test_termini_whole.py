"""Termini of all documents, non-ASCII ones too, against plain Python over code points."""

import string
from collections import defaultdict
from pathlib import Path

import pytest

from strandframe.functions import sequence as sq
from strandframe.operators import termini
from strandframe.plans import catalog

SF = Path("/root/testdata/sf0.001")
UPPER = str.maketrans(string.ascii_lowercase, string.ascii_uppercase)
COMPLEMENT = str.maketrans(sq.IUPAC, sq.IUPAC_COMPLEMENT)


@pytest.fixture(scope="module")
def ends(spark):
    """(doc_id, end, found_in, motif); the ends of the reverse complement are turned back."""
    turn = lambda s: s[::-1].translate(COMPLEMENT)
    out = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        s = (r.text or "").translate(UPPER)
        if len(s) >= 6:
            rc = turn(s)
            out += [(r.doc_id, "5prime", "fwd_on_5_end", s[:6]), (r.doc_id, "3prime", "fwd_on_3_end", s[-6:]), (r.doc_id, "3prime", "rc_on_3_end", turn(rc[:6])), (r.doc_id, "5prime", "rc_on_5_end", turn(rc[-6:]))]
    return out


@pytest.fixture(scope="module")
def groups(ends):
    by = defaultdict(list)
    for e in ends:
        by[e[3]].append(e)
    return {m: own for m, own in by.items() if len(own) > 1}


def label(own):
    return own[0][1] if len({e[1] for e in own}) == 1 else "mixed"


def test_exact_groups(spark, groups):
    got = {r.motif: (r.member_count, r.n_members, r.found_in, r.end_label) for r in catalog.QUERIES["termini_exact"](spark, str(SF)).collect()}
    assert got == {m: (len(own), len({e[0] for e in own}), ",".join(sorted({e[2] for e in own})), label(own)) for m, own in groups.items()}
    assert any(not m.isascii() for m in got)


def test_membership(spark, ends, groups):
    order = sorted(groups, key=lambda m: (label(groups[m]), -len(groups[m]), m.encode()))
    number = {m: k + 1 for k, m in enumerate(order)}
    want = {}
    for k, d in enumerate(sorted({e[0] for e in ends})):
        want[d] = [-(2 * k + 1), -(2 * k + 2)]
    for d, end, _, m in ends:
        if m in number:
            at = end == "3prime"
            want[d][at] = number[m] if want[d][at] < 0 else min(want[d][at], number[m])
    got = {r.contig_id: [r.group_5prime, r.group_3prime] for r in catalog.QUERIES["termini_membership"](spark, str(SF)).collect()}
    assert got == want


def test_lengths_in_characters(spark):
    df = spark.createDataFrame([(1, "ééé"), (2, "éAAAAA"), (3, None)], "id long, s string")
    got = {(r.contig_id, r.motif_start, r.motif_min) for r in termini.signatures(df, "id", "s", 6, 6, "plus").collect()}
    assert got == {(2, 1, "éAAAAA")}
