"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from editpairs.llm import bit_sliced, exact_dedup, hard_negatives, language_id, merkle, mixing, near_join, packing, paragraphs, repeated_substrings, secrets, token_files, warc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_token_files": token_files.op2_token_files,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_repeated_substrings": repeated_substrings.op5_repeated_substrings,
    "op6_top_k": bit_sliced.op6_top_k,
    "op7_paragraph_dedup": paragraphs.op7_paragraph_dedup,
    "op8_jaccard_join": near_join.op8_jaccard_join,
    "op9_mix": mixing.op9_mix,
    "op10_pack": packing.op10_pack,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_warc": warc.op12_warc,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

SQL = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op6_top_k": bit_sliced.OP6_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_warc": warc.OP12_SQL,
}
