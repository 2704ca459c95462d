"""The generic genetic codes, from the reference's tables in TCAG order."""

import pytest

from strandframe.functions import sequence as sq

REST = "LLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
STARTS = "---M---------------M------------MMMM---------------M------------"
CODES = {6000: "QQCCW", 7001: "*QCCW", 7010: "Q*CCW", 7100: "QQCC*", 8011: "**CCW", 8101: "*QCC*", 8110: "Q*CC*", 9111: "**CC*", 666: "12CC3"}


@pytest.mark.parametrize("code", CODES)
def test_generic_code(code):
    plain = "FFLLSSSSYY" + CODES[code] + "W" + REST
    starts = "---M---------------M---------------M" + "-" * 28 if code == 666 else STARTS
    codons = [a + b + c for a in sq.BASES for b in sq.BASES for c in sq.BASES]
    assert len(plain) == len(starts) == 64
    assert sq.translation_table(code, mark_starts=False) == dict(zip(codons, plain, strict=True))
    assert sq.translation_table(code) == {k: x.lower() if s == "M" else x for k, x, s in zip(codons, plain, starts, strict=True)}
