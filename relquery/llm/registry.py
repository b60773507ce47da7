"""Queries of the corpus operators, by name, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from relquery.llm import decontaminate, hash_tree, html_blocks, lattice_dedup, length_histogram, line_spread, ngram_join, pii_feistel, quality_gam, ss_packing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_blocks": html_blocks.op1_html_blocks,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op3_hash_tree": hash_tree.op3_hash_tree,
        "op4_length_histogram": length_histogram.op4_length_histogram,
        "op5_quality_gam": quality_gam.op5_quality_gam,
        "op6_simhash_decontamination": decontaminate.op6_simhash_decontamination,
        "op7_pii_feistel": pii_feistel.op7_pii_feistel,
        "op8_ss_packing": ss_packing.op8_ss_packing,
        "op9_line_spread": line_spread.op9_line_spread,
        "op10_lattice_dedup": lattice_dedup.op10_lattice_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": ngram_join.oracle(), "op9_line_spread": line_spread.oracle(), "op10_lattice_dedup": lattice_dedup.oracle()}
