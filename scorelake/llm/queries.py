"""The corpus operators' queries and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, infill, language, licenses, personal, pieces, secrets, sharding, simhash, substrings, toxicity, tries, winnowing

QUERIES = {
    "op1_winnowing": winnowing.op1_winnowing,
    "op2_prefix_doubling": substrings.op2_prefix_doubling,
    "op3_gumbel_topk": pieces.op3_gumbel_topk,
    "op4_script_viterbi": language.op4_script_viterbi,
    "op5_sentence_rules": licenses.op5_sentence_rules,
    "op6_hash_tree": sharding.op6_hash_tree,
    "op7_random_secrets": secrets.op7_random_secrets,
    "op8_simhash": simhash.op8_simhash,
    "op9_simhash_windows": decontamination.op9_simhash_windows,
    "op10_subword_bags": toxicity.op10_subword_bags,
    "op11_prefix_trie": tries.op11_prefix_trie,
    "op12_contextual_extraction": personal.op12_contextual_extraction,
    "op13_distinct_text_index": infill.op13_distinct_text_index,
}
ORACLE_SQL = {"op6_hash_tree": sharding.OP6_SQL, "op11_prefix_trie": tries.OP11_SQL, "op13_distinct_text_index": infill.OP13_SQL}
