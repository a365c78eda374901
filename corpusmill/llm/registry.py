"""The queries of the subpackage and their SQL."""

from __future__ import annotations

from . import (
    op1_sharding, op2_lines, op3_mixing, op4_licenses, op5_passages, op6_simhash, op7_warc, op8_quality, op9_suffix_dedup, op10_decontaminate, op11_repair, op12_byte_bpe,
    op13_whitening,
)

MODULES = (
    op1_sharding, op2_lines, op3_mixing, op4_licenses, op5_passages, op6_simhash, op7_warc, op8_quality, op9_suffix_dedup, op10_decontaminate, op11_repair, op12_byte_bpe,
    op13_whitening,
)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: q for m in MODULES for name, q in m.ORACLES.items()}
