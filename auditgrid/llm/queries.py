"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from auditgrid.llm import ball_kmeans, best_fit_packing, bpe_replay, chat_template, exact_dedup, language_id, mixing, prefix_trie, quality_bands, simhash, substring_dedup, token_transducer, toxicity


def queries() -> dict:
    return {
        "op1_compression_bands": quality_bands.op1_compression_bands,
        "op2_simhash_pivots": simhash.op2_simhash_pivots,
        "op3_substring_automata": substring_dedup.op3_substring_automata,
        "op4_token_transducer": token_transducer.op4_token_transducer,
        "op5_block_naming": exact_dedup.op5_block_naming,
        "op6_toxicity_lexicon": toxicity.op6_toxicity_lexicon,
        "op7_bin_completion": best_fit_packing.op7_bin_completion,
        "op8_merge_replay": bpe_replay.op8_merge_replay,
        "op9_template_compiler": chat_template.op9_template_compiler,
        "op10_word_backoff": language_id.op10_word_backoff,
        "op11_pareto_mix": mixing.op11_pareto_mix,
        "op12_ball_kmeans": ball_kmeans.op12_ball_kmeans,
        "op13_family_trie": prefix_trie.op13_family_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_substring_automata": substring_dedup.SQL, "op5_block_naming": exact_dedup.SQL, "op11_pareto_mix": mixing.SQL, "op12_ball_kmeans": ball_kmeans.SQL, "op13_family_trie": prefix_trie.SQL}
