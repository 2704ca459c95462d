"""IBANs that capitals or digits follow."""

import pytest

from strandframe.llm import pii

DE, GB = "DE89370400440532013000", "GB29NWBK60161331926819"
SPACED = "DE89 3704 0044 0532 0130 00"


@pytest.mark.parametrize("text, want", [
    (f"{SPACED} BIC COBADEFF", [SPACED]), (f"{DE} 2024", [DE]), (f"{DE} A sentence", [DE]), (f"pay {SPACED} NOW OR 12 LATER", [SPACED]), (f"{DE} {GB} {SPACED}", [DE, GB, SPACED]), (f"AB12 3456 {DE}", [DE]),
    (DE, [DE]), (f"{SPACED} and", [SPACED]), ("DE88370400440532013000 2024", []), (f"x{DE} 2024", []), (f"{DE}x", []),
])
def test_iban_before_capitals_and_digits(text, want):
    assert [text[s:e] for s, e, kind, _ in pii.find_spans(text) if kind == "iban"] == want
