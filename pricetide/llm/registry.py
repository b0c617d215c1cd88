"""Queries of the corpus operators and the SQL statements for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from pricetide.llm import conversation_trie, decontaminate, graph_search, jaccard, language, mixing, perplexity, quality, resample, substrings, tokens, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_perplexity_rules": perplexity.op1_perplexity_rules,
        "op2_pareto_mix": mixing.op2_pareto_mix,
        "op3_super_kmer_dedup": substrings.op3_super_kmer_dedup,
        "op4_token_counts": tokens.op4_token_counts,
        "op5_warc_archives": warc.op5_warc_archives,
        "op6_bm25_decontamination": decontaminate.op6_bm25_decontamination,
        "op7_pu_quality": quality.op7_pu_quality,
        "op8_compression_toxicity": toxicity.op8_compression_toxicity,
        "op9_adaptive_jaccard": jaccard.op9_adaptive_jaccard,
        "op10_rank_order_language": language.op10_rank_order_language,
        "op11_graph_neighbours": graph_search.op11_graph_neighbours,
        "op12_conversation_trie": conversation_trie.op12_conversation_trie,
        "op13_importance_resampling": resample.op13_importance_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_pareto_mix": mixing.OP2_SQL,
        "op3_super_kmer_dedup": substrings.OP3_SQL,
        "op5_warc_archives": warc.OP5_SQL,
        "op11_graph_neighbours": graph_search.OP11_SQL,
        "op12_conversation_trie": conversation_trie.OP12_SQL,
        "op13_importance_resampling": resample.OP13_SQL,
    }
