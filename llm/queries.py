"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from llm import op1_token_counts, op2_toxicity, op3_chat, op4_embeddings, op5_language, op6_suffix, op7_jaccard, op8_bpe, op9_token_files, op10_decontaminate, op11_alignment, op12_whitening, op13_pii

QUERIES = {
    "op1_token_counts": op1_token_counts.op1_token_counts,
    "op2_toxicity": op2_toxicity.op2_toxicity,
    "op3_chat": op3_chat.op3_chat,
    "op4_embeddings": op4_embeddings.op4_embeddings,
    "op5_language": op5_language.op5_language,
    "op6_suffix": op6_suffix.op6_suffix,
    "op7_jaccard": op7_jaccard.op7_jaccard,
    "op8_bpe": op8_bpe.op8_bpe,
    "op9_token_files": op9_token_files.op9_token_files,
    "op10_decontaminate": op10_decontaminate.op10_decontaminate,
    "op11_alignment": op11_alignment.op11_alignment,
    "op12_whitening": op12_whitening.op12_whitening,
    "op13_pii": op13_pii.op13_pii,
}
ORACLES = {"op3_chat": op3_chat.SQL, "op4_embeddings": op4_embeddings.SQL}
