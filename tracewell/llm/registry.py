"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bagminhash import op3_bagminhash
from .bm25_wand import OP4_SQL, op4_bm25_topk
from .bpe_automaton import op10_bpe_codec
from .embed_int8 import OP8_SQL, op8_embedding_dedup
from .line_spread import OP5_SQL, op5_line_spread
from .packing import op2_packing
from .pii_boost import op9_pii
from .prefix_tokens import op7_token_counts
from .quality_fm import op1_quality_fm
from .sparse_suffix import op6_repeated_passages


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_fm": op1_quality_fm,
        "op2_packing": op2_packing,
        "op3_bagminhash": op3_bagminhash,
        "op4_bm25_topk": op4_bm25_topk,
        "op5_line_spread": op5_line_spread,
        "op6_repeated_passages": op6_repeated_passages,
        "op7_token_counts": op7_token_counts,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_pii": op9_pii,
        "op10_bpe_codec": op10_bpe_codec,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_bm25_topk": OP4_SQL,
        "op5_line_spread": OP5_SQL,
        "op8_embedding_dedup": OP8_SQL,
    }
