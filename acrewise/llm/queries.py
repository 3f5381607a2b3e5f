"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from acrewise.llm import debruijn_dedup, decontaminate, divergence, jaccard_join, line_dedup, mixture, quality, setsketch, shards, spelling, suffix_dedup, token_counts, warc

QUERIES = {
    "op1_spaced_seeds": decontaminate.op1,
    "op2_proportional_interleave": shards.op2,
    "op3_segment_reassembly": warc.op3,
    "op4_voronoi_jaccard": jaccard_join.op4,
    "op5_distribution_divergence": quality.op5,
    "op6_transducer_counts": token_counts.op6,
    "op7_cover_sample_dedup": suffix_dedup.op7,
    "op8_raked_mixture": mixture.op8,
    "op9_debruijn_dedup": debruijn_dedup.op9,
    "op10_line_bitmaps": line_dedup.op10,
    "op11_setsketch": setsketch.op11,
    "op12_pointer_divergence": divergence.op12,
    "op13_trie_frontier": spelling.op13,
}
SQL = {
    "op1_spaced_seeds": decontaminate.SQL,
    "op2_proportional_interleave": shards.SQL,
    "op3_segment_reassembly": warc.SQL,
    "op4_voronoi_jaccard": jaccard_join.SQL,
    "op5_distribution_divergence": quality.SQL,
    "op7_cover_sample_dedup": suffix_dedup.SQL,
    "op8_raked_mixture": mixture.SQL,
    "op9_debruijn_dedup": debruijn_dedup.SQL,
    "op10_line_bitmaps": line_dedup.SQL,
    "op11_setsketch": setsketch.SQL,
    "op12_pointer_divergence": divergence.SQL,
    "op13_trie_frontier": spelling.SQL,
}
