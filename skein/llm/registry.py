"""Queries of the training-data operators, by name, with oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, infill, language, media, minhash, mixing, passages, pieces, quality, repeats, spelling, tokens, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_quality": quality.op3_quality,
        "op4_tokens": tokens.op4_tokens,
        "op5_language": language.op5_language,
        "op6_minhash": minhash.op6_minhash,
        "op7_sentencepiece": pieces.op7_sentencepiece,
        "op8_suffix_dedup": repeats.op8_suffix_dedup,
        "op9_warc": warc.op9_warc,
        "op10_media": media.op10_media,
        "op11_spelling": spelling.op11_spelling,
        "op12_passages": passages.op12_passages,
        "op13_infill": infill.op13_infill,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.OP2_SQL, "op9_warc": warc.OP9_SQL, "op12_passages": passages.OP12_SQL, "op13_infill": infill.OP13_SQL}
