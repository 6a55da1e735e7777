"""The registered queries of this subpackage; where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .interactions import op11_interactions
from .mih import op4_nearest
from .oracles import ORACLE_SQL
from .packing import op8_packing
from .pii import op6_pii
from .quality import op10_quality
from .resample import op12_resample
from .simhash import op9_simhash
from .spm import op2_sentencepiece
from .substring import op5_substring
from .tokenfiles import op13_token_files
from .topk import op3_topk
from .toxicity import op7_toxicity
from .urls import op1_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_urls": op1_urls,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_topk": op3_topk,
    "op4_nearest": op4_nearest,
    "op5_substring": op5_substring,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_packing": op8_packing,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "op11_interactions": op11_interactions,
    "op12_resample": op12_resample,
    "op13_token_files": op13_token_files,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
