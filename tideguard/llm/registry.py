"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from importlib import import_module

#: query -> module; each has query(spark, sf_dir) and, where SQL can express it, ORACLE_SQL.
MODULES = {
    "op1_jpeg_media": "jpeg",
    "op2_warc_revisits": "warc",
    "op3_page_differencing": "html_text",
    "op4_factorization_machine": "toxicity",
    "op5_histogram_sort": "histogram_sort",
    "op6_line_crf": "line_crf",
    "op7_best_fit_packing": "best_fit",
    "op8_poisson_mixing": "poisson_mix",
    "op9_token_counts": "token_counts",
    "op10_simhash_near_dedup": "simhash",
    "op11_token_alignment": "token_align",
    "op12_lexical_search": "lexical_search",
    "op13_url_filter": "url_filter",
}


def queries() -> dict:
    return {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
