"""The queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, language, mainpage, mixing, mpeg, quality, simhash, tokenfiles, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality": quality.op1_quality,
        "op2_bpe": bpe.op2_bpe,
        "op3_html": mainpage.op3_html,
        "op4_mixing": mixing.op4_mixing,
        "op5_language": language.op5_language,
        "op6_arrow_sequences": tokenfiles.op6_arrow_sequences,
        "op7_mpeg": mpeg.op7_mpeg,
        "op8_chat": chat.op8_chat,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_simhash": simhash.op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality": quality.ORACLE_SQL,
    }
