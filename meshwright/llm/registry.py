"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshwright.llm import bpe, lines, media, mixing, nearmin, negatives, neighbours, packing, resampling, secretscan, sharding, toxicity, urls

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_media_chunks": media.op1_media_chunks,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_secret_scan": secretscan.op4_secret_scan,
    "op5_jump_shards": sharding.op5_jump_shards,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_nearest": neighbours.op7_nearest,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_near_duplicates": nearmin.op9_near_duplicates,
    "op10_url_filter": urls.op10_url_filter,
    "op11_source_mix": mixing.op11_source_mix,
    "op12_resample": resampling.op12_resample,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op9_near_duplicates": nearmin.OP9_SQL,
    "op10_url_filter": urls.OP10_SQL,
    "op11_source_mix": mixing.OP11_SQL,
    "op12_resample": resampling.OP12_SQL,
    "op13_hard_negatives": negatives.OP13_SQL,
}
