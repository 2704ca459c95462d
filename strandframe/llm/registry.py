"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import chat, decontaminate, media, mixing, neardup, pii, quality, repeats, toxicity, warc

QUERIES = {
    "op1_chat_format": chat.query,
    "op2_quality": quality.query,
    "op3_repeats": repeats.query,
    "op4_mixing": mixing.query,
    "op5_pii": pii.query,
    "op6_warc": warc.query,
    "op7_toxicity": toxicity.query,
    "op8_near_duplicates": neardup.query,
    "op9_media": media.query,
    "op10_decontaminate": decontaminate.query,
}
ORACLES = {"op1_chat_format": chat.ORACLE, "op6_warc": warc.ORACLE}
