"""The registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from . import (decontaminate, digest_index, fertility, language_model, ngram_join, packing, pii, prefix_trie, quality,
               simple8b, toxicity, vector_codes, warc)
from .common import ship


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with this package given to the tasks first."""
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)
    return run


QUERIES = {name: shipped(query) for name, query in {
    "op1_pii_weak_supervision": pii.op1_pii_weak_supervision,
    "op2_packing_nnls": packing.op2_packing_nnls,
    "op3_simple8b_ids": simple8b.op3_simple8b_ids,
    "op4_backoff_automaton": language_model.op4_backoff_automaton,
    "op5_quality_compression": quality.op5_quality_compression,
    "op6_ngram_jaccard": ngram_join.op6_ngram_jaccard,
    "op7_warc_bundles": warc.op7_warc_bundles,
    "op8_toxicity_ftrl": toxicity.op8_toxicity_ftrl,
    "op9_decontaminate_index": decontaminate.op9_decontaminate_index,
    "op10_exact_dedup": digest_index.op10_exact_dedup,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_fertility_rules": fertility.op13_fertility_rules,
}.items()}
ORACLE_SQL = {
    "op7_warc_bundles": warc.ORACLE_SQL,
    "op9_decontaminate_index": decontaminate.ORACLE_SQL,
    "op10_exact_dedup": digest_index.ORACLE_SQL,
    "op11_prefix_trie": prefix_trie.ORACLE_SQL,
    "op12_vector_codes": vector_codes.ORACLE_SQL,
}
