"""The registered queries of this package and their SQL twins."""

from __future__ import annotations

from txrisk.llm import (
    decontamination,
    fill_in_middle,
    filter_audit,
    html_text,
    jaccard,
    line_templates,
    metric_tree,
    mixing,
    quality,
    separators,
    tiled_cosine,
    token_orc,
    toxicity,
)

QUERIES = {
    "op1_site_style_tree": html_text.op1_site_style_tree,
    "op2_metric_tree_search": metric_tree.op2_metric_tree_search,
    "op3_template_lines": line_templates.op3_template_lines,
    "op4_token_orc": token_orc.op4_token_orc,
    "op5_latent_neighbours": quality.op5_latent_neighbours,
    "op6_separator_scan": separators.op6_separator_scan,
    "op7_latent_decontamination": decontamination.op7_latent_decontamination,
    "op8_string_kernel_toxicity": toxicity.op8_string_kernel_toxicity,
    "op9_systematic_mix": mixing.op9_systematic_mix,
    "op10_order_filter_join": jaccard.op10_order_filter_join,
    "op11_chunk_memo_fim": fill_in_middle.op11_chunk_memo_fim,
    "op12_survival_words": filter_audit.op12_survival_words,
    "op13_pca_tiled_dedup": tiled_cosine.op13_pca_tiled_dedup,
}

ORACLES = {
    "op2_metric_tree_search": metric_tree.SQL,
    "op9_systematic_mix": mixing.SQL,
    "op11_chunk_memo_fim": fill_in_middle.SQL,
    "op12_survival_words": filter_audit.SQL,
    "op13_pca_tiled_dedup": tiled_cosine.SQL,
}
