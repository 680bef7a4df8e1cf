"""The numbered queries and, where SQL can express one, its DuckDB form."""

from __future__ import annotations

from profloom.llm import (
    op01_line_dedup,
    op02_cover_tree,
    op03_toxicity,
    op04_ngram_join,
    op05_mixture,
    op06_suffix_dedup,
    op07_decontaminate,
    op08_lattice_lm,
    op09_license_scan,
    op10_url_filter,
    op11_collocations,
    op12_spelling,
    op13_warc,
)

QUERIES = {
    "op1_line_dedup": op01_line_dedup.op1_line_dedup,
    "op2_cover_tree": op02_cover_tree.op2_cover_tree,
    "op3_toxicity": op03_toxicity.op3_toxicity,
    "op4_ngram_join": op04_ngram_join.op4_ngram_join,
    "op5_mixture": op05_mixture.op5_mixture,
    "op6_suffix_dedup": op06_suffix_dedup.op6_suffix_dedup,
    "op7_decontaminate": op07_decontaminate.op7_decontaminate,
    "op8_lattice_lm": op08_lattice_lm.op8_lattice_lm,
    "op9_license_scan": op09_license_scan.op9_license_scan,
    "op10_url_filter": op10_url_filter.op10_url_filter,
    "op11_collocations": op11_collocations.op11_collocations,
    "op12_spelling": op12_spelling.op12_spelling,
    "op13_warc": op13_warc.op13_warc,
}

ORACLES = {
    "op1_line_dedup": op01_line_dedup.ORACLE,
    "op2_cover_tree": op02_cover_tree.ORACLE,
    "op4_ngram_join": op04_ngram_join.ORACLE,
    "op5_mixture": op05_mixture.ORACLE,
    "op6_suffix_dedup": op06_suffix_dedup.ORACLE,
    "op9_license_scan": op09_license_scan.ORACLE,
    "op10_url_filter": op10_url_filter.ORACLE,
    "op11_collocations": op11_collocations.ORACLE,
    "op12_spelling": op12_spelling.ORACLE,
    "op13_warc": op13_warc.ORACLE,
}
