"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat, decontam, jaccard, langid, mixing, quality, sentences, suffix, toxicity
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_cross_polytope": lambda s, d: ann.report(table(s, d, "embeddings")),
        "op2_decontaminate": lambda s, d: decontam.report(table(s, d, "documents"), table(s, d, "benchmark")),
        "op3_cross_parsing": lambda s, d: langid.report(table(s, d, "documents")),
        "op4_sentence_spans": lambda s, d: sentences.report(table(s, d, "documents")),
        "op5_rule_ensemble": lambda s, d: quality.report(table(s, d, "documents"), table(s, d, "labels")),
        "op6_suffix_dedup": lambda s, d: suffix.report(table(s, d, "documents")),
        "op7_chat_format": lambda s, d: chat.report(table(s, d, "conversations")),
        "op8_mix_sources": lambda s, d: mixing.report(table(s, d, "documents")),
        "op9_toxic_lexicon": lambda s, d: toxicity.report(table(s, d, "documents"), table(s, d, "labels")),
        "op10_chosen_path": lambda s, d: jaccard.join(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": decontam.SQL, "op4_sentence_spans": sentences.SQL, "op7_chat_format": chat.SQL, "op10_chosen_path": jaccard.SQL}
