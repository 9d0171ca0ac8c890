"""Queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, embeddings, html, language, pieces, quality, secrets, sharding, simhash, substrings


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op2_proximity": decontaminate.op2_proximity,
        "op3_secrets": secrets.op3_secrets,
        "op4_language": language.op4_language,
        "op5_simhash": simhash.op5_simhash,
        "op6_html": html.op6_html,
        "op7_substrings": substrings.op7_substrings,
        "op8_embeddings": embeddings.op8_embeddings,
        "op9_pieces": pieces.op9_pieces,
        "op10_quality": quality.op10_quality,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontaminate.ORACLE, "op6_html": html.ORACLE, "op7_substrings": substrings.ORACLE, "op8_embeddings": embeddings.ORACLE}
