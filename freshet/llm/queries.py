"""The operators' queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from . import cotrain, decontam, exact_dedup, merkle, mixing, negatives, ngram_join, pii, secrets, simhash, suffix_tree, tokenbin, warc

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_suffix_tree": suffix_tree.op2_suffix_tree,
    "op3_warc": warc.op3_warc,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_quality": cotrain.op5_quality,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_token_binary": tokenbin.op7_token_binary,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_pii": pii.op9_pii,
    "op10_decontaminate": decontam.op10_decontaminate,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_simhash_trie": simhash.op13_simhash_trie,
}

SQL = {
    "op4_mix_sources": mixing.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op8_secret_scan": secrets.SQL,
    "op10_decontaminate": decontam.SQL,
    "op11_hard_negatives": negatives.SQL,
    "op12_merkle_manifest": merkle.SQL,
}
