"""The operators' queries and their SQL, by the names under which they are registered."""

from __future__ import annotations

from stepweave.llm import op1_substrings, op2_quality, op3_language, op4_urls, op5_pii, op6_decontamination, op7_tokens, op8_mixing, op9_minhash, op10_attention, op11_negatives, op12_token_files, op13_filter_audit

_MODULES = {
    "op1_substrings": op1_substrings,
    "op2_quality_rules": op2_quality,
    "op3_language": op3_language,
    "op4_urls": op4_urls,
    "op5_pii": op5_pii,
    "op6_decontamination": op6_decontamination,
    "op7_tokens": op7_tokens,
    "op8_mixing": op8_mixing,
    "op9_minhash": op9_minhash,
    "op10_attention": op10_attention,
    "op11_negatives": op11_negatives,
    "op12_token_files": op12_token_files,
    "op13_filter_audit": op13_filter_audit,
}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in _MODULES.items() if getattr(module, "ORACLE", None)}
