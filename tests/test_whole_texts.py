"""Queries over all documents, non-ASCII ones too, against plain Python over code points."""

import hashlib
import re
import string
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandframe.functions import sequence as sq
from strandframe.operators import tables
from strandframe.plans import catalog

SF = Path("/root/testdata/sf0.001")
UPPER = str.maketrans(string.ascii_lowercase, string.ascii_uppercase)
COMPLEMENT = str.maketrans(sq.IUPAC, sq.IUPAC_COMPLEMENT)


@pytest.fixture(scope="module")
def docs(spark):
    got = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert any(not t.isascii() for t in got.values() if t)
    return {k: t for k, t in got.items() if t is not None}


def rows(spark, name):
    return catalog.QUERIES[name](spark, str(SF)).collect()


def upper(text):
    return text.translate(UPPER)


def revcomp(text):
    return text[::-1].translate(COMPLEMENT)


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def protein(text, frame, code):
    s = upper(re.sub(r"[ \t\n\x0b\f\r]+", "", text)).replace("U", "T")
    s = (s if frame > 0 else revcomp(s))[abs(frame) - 1 :]
    table = sq.translation_table(code)
    return "".join(table.get(s[k : k + 3], "X") for k in range(0, len(s) - 2, 3))


def test_revcomp(spark, docs):
    got = {r.doc_id: r.rc for r in rows(spark, "revcomp")}
    assert {k: got[k] for k in docs} == {k: md5(revcomp(upper(t))) for k, t in docs.items()}


def test_translations(spark, docs):
    got = {r.doc_id: r.protein for r in rows(spark, "translate_frame")}
    assert {k: got[k] for k in docs} == {k: protein(t, 1, 1) for k, t in docs.items()}
    six = {(r.doc_id, r.frame): r.protein for r in rows(spark, "six_frame")}
    assert {k: v for k, v in six.items() if k[0] in docs} == {(k, f): md5(protein(t, f, 11)) for k, t in docs.items() for f in sq.FRAMES}


def test_open_reading_frames(spark, docs):
    found = {k: [len(x) for x in protein(t, 1, 1).split("*") if len(x) >= 16] for k, t in docs.items()}
    assert {r.doc_id: (r.n_orfs, r.longest) for r in rows(spark, "open_reading_frames")} == {k: (len(v), max(v)) for k, v in found.items() if v}


def test_codon_usage(spark, docs):
    found = {k: Counter(c for c in re.findall("(?s)...", upper(t)) if "N" not in c) for k, t in docs.items()}
    got = {r.doc_id: (r.codons, r.top_share) for r in rows(spark, "codon_usage")}
    assert set(got) == {k for k, v in found.items() if v}
    assert all(got[k] == (len(v), pytest.approx(max(v.values()) / v.total(), abs=1e-6)) for k, v in found.items() if v)


def test_dedup_revcomp(spark, docs):
    first = {}
    for k in sorted(docs):
        first.setdefault(min(upper(docs[k]), revcomp(upper(docs[k]))), k)
    assert {r.doc_id for r in rows(spark, "dedup_revcomp")} & set(docs) == set(first.values())


def test_strand_keys_are_computed_once_a_side(spark):
    """No filter on the scan computes the key of deduplication a second time."""
    df = spark.createDataFrame([(1, "ACGT"), (2, "acgt"), (3, "é"), (4, None), (5, "")], "id long, s string")
    kept = tables.deduplicate(df, sq.least_strand("s"), ["id"])
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2
    assert sorted(r.id for r in kept.collect()) == [1, 3, 4]


def test_translation_of_gaps_spaces_and_other_letters(spark):
    text = "a t\ng---tuu\u00a0éA-CN\x00ACGTA"
    clean = text.replace(" ", "").replace("\n", "").upper().replace("U", "T")
    strand = {1: clean, -1: clean[::-1].translate(str.maketrans("ACGT", "TGCA"))}
    table = sq.translation_table(11) | {"---": "-"}
    for sign, whole in strand.items():
        for at in (1, 2, 3):
            row = spark.createDataFrame([(text,), ("",), (" ac ",), (None,)], "s string").select(sq.translate(F.col("s"), sign * at, 11)).collect()
            want = "".join(table.get(whole[i : i + 3], "X") for i in range(at - 1, len(whole) - 2, 3))
            assert [r[0] for r in row] == [want, "", "", None]
