"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe, embedding_lsh, exact_dedup, language_id, lm_pseudo, mixing, pii_crf, quality_fm, simhash_vp, suffix_dedup

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_pii_crf": pii_crf.op2_pii_crf,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_embedding_lsh": embedding_lsh.op4_embedding_lsh,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_quality_fm": quality_fm.op7_quality_fm,
    "op8_lm_pseudo": lm_pseudo.op8_lm_pseudo,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_simhash_vp": simhash_vp.op10_simhash_vp,
}
SQL = {"op3_exact_dedup": exact_dedup.OP3_SQL, "op4_embedding_lsh": embedding_lsh.OP4_SQL, "op6_suffix_dedup": suffix_dedup.OP6_SQL}
