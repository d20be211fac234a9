"""The queries of this folder: name to function of (spark, folder of tables), and SQL where it can say the same."""

from __future__ import annotations

from importlib import import_module

#: Module, query.
MODULES = [("line_dedup", "op1_line_dedup"), ("decontaminate", "op2_decontaminate"), ("lm", "op3_lm_score"), ("warc", "op4_warc_audit"), ("licenses", "op5_license_scan"), ("chat", "op6_format_chat"), ("quality", "op7_quality_rules"), ("set_join", "op8_jaccard_join"), ("mixing", "op9_mix_sources"), ("token_store", "op10_token_store"), ("order_minhash", "op11_order_minhash"), ("search", "op12_ranked_search"), ("fill_middle", "op13_fill_middle")]


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for module, name in MODULES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module, name in MODULES if (sql := getattr(import_module(f"{__package__}.{module}"), "SQL", None))}
