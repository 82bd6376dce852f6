"""The operators' registered queries, and DuckDB SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, language, lexical, lines, lm, neardup, quality, suffixes, topk, toxicity, whitening
from .sharding import op9_hilbert_shards


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_duplicates": neardup.op1_near_duplicates,
        "op2_kd_top_k": topk.op2_kd_top_k,
        "op3_quality_scores": quality.op3_quality_scores,
        "op4_toxicity_scores": toxicity.op4_toxicity_scores,
        "op5_lm_scores": lm.op5_lm_scores,
        "op6_line_dedup": lines.op6_line_dedup,
        "op7_bpe_round_trip": bpe.op7_bpe_round_trip,
        "op8_repeated_passages": suffixes.op8_repeated_passages,
        "op10_contaminated": decontam.op10_contaminated,
        "op9_hilbert_shards": op9_hilbert_shards,
        "op11_languages": language.op11_languages,
        "op12_whitened": whitening.op12_whitened,
        "op13_lexical_search": lexical.op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_kd_top_k": topk.OP2_SQL,
        "op6_line_dedup": lines.OP6_SQL,
        "op13_lexical_search": lexical.OP13_SQL,
    }
