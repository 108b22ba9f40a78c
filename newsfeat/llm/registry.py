"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsfeat.llm import (bpe, conversations, hnsw, jaccard, langid, licences, linededup, mixing, passages,
                          periods, simhash, toxicity, winnowing)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_winnowing": winnowing.q_winnowing,
        "op2_toxicity": toxicity.q_toxicity,
        "op3_line_dedup": linededup.q_line_dedup,
        "op3_line_dedup_runs": linededup.q_line_dedup_runs,
        "op4_licence_scan": licences.q_licences,
        "op5_simhash_near_dedup": simhash.q_simhash,
        "op6_hnsw": hnsw.q_hnsw,
        "op7_language_id": langid.q_langid,
        "op8_mixing": mixing.q_mixing,
        "op9_byte_bpe": bpe.q_bpe,
        "op10_passage_dedup": passages.q_passages,
        "op11_ngram_jaccard": jaccard.q_jaccard,
        "op12_periodic_runs": periods.q_periods,
        "op13_conversation_repair": conversations.q_conversations,
    }


def oracle_sql() -> dict[str, str]:
    """Fingerprints, trained models, components, graphs and BPE merges have no
    SQL form; their tests compare with brute force."""
    return {
        "op3_line_dedup": linededup.SQL,
        "op4_licence_scan": licences.SQL,
        "op8_mixing": mixing.SQL,
        "op10_passage_dedup": passages.SQL,
        "op11_ngram_jaccard": jaccard.SQL,
    }
