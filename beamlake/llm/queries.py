"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from beamlake.llm.decontaminate import op8_latent_semantic_decontamination
from beamlake.llm.lm import op6_gated_recurrent_lm
from beamlake.llm.near_dedup import op4_super_minhash_dedup
from beamlake.llm.packing import op3_large_item_packing
from beamlake.llm.quality import op7_covariance_outliers
from beamlake.llm.substring_dedup import op5_level_doubling_dedup
from beamlake.llm.suffix_dedup import op10_interval_expansion_dedup
from beamlake.llm.token_counts import op9_two_tier_token_counts
from beamlake.llm.token_output import op1_repair_token_output
from beamlake.llm.toxicity import op2_ftrl_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_repair_token_output,
        op2_ftrl_toxicity,
        op3_large_item_packing,
        op4_super_minhash_dedup,
        op5_level_doubling_dedup,
        op6_gated_recurrent_lm,
        op7_covariance_outliers,
        op8_latent_semantic_decontamination,
        op9_two_tier_token_counts,
        op10_interval_expansion_dedup,
    )
}
#: SQL has no tokenizer, trained model or signature; tests/llm compares each query with a brute-force version instead.
SQL: dict[str, str] = {}
