"""The registered queries of the operators and the SQL that gives the same rows, where SQL can express them."""

from __future__ import annotations

from . import decontaminate, host_rules, line_dedup, lm_score, packing, pii, sharding, simhash, toxicity, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        packing.op1_cost_balanced_packing,
        toxicity.op2_toxic_spans,
        url_filter.op3_url_filter_cascade,
        pii.op4_weak_supervision_pii,
        sharding.op5_hilbert_shards,
        host_rules.op6_host_rules,
        line_dedup.op7_line_alignment,
        decontaminate.op8_spaced_seed_decontamination,
        simhash.op9_simhash_trie,
        lm_score.op10_backoff_automaton,
    )
}
ORACLE_SQL = {"op3_url_filter_cascade": url_filter.OP3_SQL, "op6_host_rules": host_rules.OP6_SQL}
