"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from . import bpe, copies, forest, jaccard, lines, packing, pivot_index, quality, runs, secrets, substrings, whitening, wrappers


def queries() -> dict[str, Callable[..., DataFrame]]:
    import corpus_pipeline

    found = [
        packing.op1_packing,
        pivot_index.op2_embedding_near_dedup,
        jaccard.op3_ngram_jaccard_join,
        secrets.op4_secret_scans,
        wrappers.op5_html_extraction,
        quality.op6_quality_classifier,
        bpe.op7_bpe,
        substrings.op8_suffix_array_dedup,
        lines.op9_line_dedup,
        forest.op10_approximate_nearest_neighbours,
        whitening.op11_embedding_whitening,
        copies.op12_exact_dedup,
        runs.op13_periodic_runs,
    ]
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op9_line_dedup": lines.ORACLE, "op12_exact_dedup": copies.ORACLE}
