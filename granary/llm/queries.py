"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: query -> module
MODULES = {
    "op1_fingerprints": "prefix_hash",
    "op2_secrets": "secret_scan",
    "op3_decontamination": "decontaminate",
    "op4_chunk_dedup": "chunks",
    "op5_arrow_ids": "arrow_ids",
    "op6_main_text": "html_blocks",
    "op7_packing": "packing",
    "op8_licences": "licence_scan",
    "op9_language": "language",
    "op10_simhash": "simhash",
}
ORACLES: dict[str, str] = {}


def queries() -> dict:
    return {name: getattr(import_module(f"granary.llm.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
