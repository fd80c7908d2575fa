"""Registered queries of the corpus operators and their SQL twins."""

from veilframe.llm import (
    bpe,
    decontam,
    embedding_dedup,
    lm_score,
    ngram_join,
    packing,
    sharding,
    substring_dedup,
    suffix_dedup,
    token_alignment,
    toxicity,
    url_filter,
    whitening,
)
from veilframe.llm.oracles import ORACLES

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_bpe": bpe.query,
    "op3_embedding_dedup": embedding_dedup.query,
    "op4_toxicity": toxicity.query,
    "op5_decontam": decontam.query,
    "op6_sharding": sharding.query,
    "op7_url_filter": url_filter.query,
    "op8_ngram_join": ngram_join.query,
    "op9_lm_score": lm_score.query,
    "op10_suffix_dedup": suffix_dedup.query,
    "op11_whitening": whitening.query,
    "op12_token_alignment": token_alignment.query,
    "op13_packing": packing.query,
}
__all__ = ["ORACLES", "QUERIES"]
