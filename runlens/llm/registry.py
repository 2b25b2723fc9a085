"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from runlens.llm import bpe, chat, collocations, epsgrid, jaccard, langid, mih, ngramlm, packing, pii, toxicity, whiten, wrappers

QUERIES = {
    "op1_chunk_reuse": bpe.op1_chunk_reuse,
    "op2_jaccard_join": jaccard.op2_jaccard_join,
    "op3_bigru": toxicity.op3_bigru,
    "op4_hamming_topk": mih.op4_hamming_topk,
    "op5_rank_order": langid.op5_rank_order,
    "op6_wrapper_induction": wrappers.op6_wrapper_induction,
    "op7_elias_fano_lm": ngramlm.op7_elias_fano_lm,
    "op8_weak_supervision": pii.op8_weak_supervision,
    "op9_best_two_fit": packing.op9_best_two_fit,
    "op10_epsilon_grid": epsgrid.op10_epsilon_grid,
    "op11_best_first_growth": collocations.op11_best_first_growth,
    "op12_template_compiler": chat.op12_template_compiler,
    "op13_whitening": whiten.op13_whitening,
}

ORACLE_SQL = {
    "op2_jaccard_join": jaccard.OP2_SQL,
    "op4_hamming_topk": mih.OP4_SQL,
    "op10_epsilon_grid": epsgrid.OP10_SQL,
    "op11_best_first_growth": collocations.OP11_SQL,
}
