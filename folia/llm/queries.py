"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .ann import op9_inverted_multi_index
from .conversations import op12_a_star_conversation_repair
from .decontaminate import op10_wu_manber_decontamination
from .embedding_dedup import op13_nn_descent_embedding_dedup
from .licenses import op2_dice_license_scan
from .near_dup import op6_tensored_minhash_near_dedup
from .packing import op7_minimum_bin_slack_packing
from .quality import op1_hierarchical_bayes_quality
from .secrets import op4_random_forest_secret_scan
from .spelling import op11_trie_spelling_variants
from .suffix_dedup import op5_suffix_sort_dedup
from .token_counts import op8_digest_cache_token_counts
from .token_output import op3_re_pair_token_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hierarchical_bayes_quality,
        op2_dice_license_scan,
        op3_re_pair_token_output,
        op4_random_forest_secret_scan,
        op5_suffix_sort_dedup,
        op6_tensored_minhash_near_dedup,
        op7_minimum_bin_slack_packing,
        op8_digest_cache_token_counts,
        op9_inverted_multi_index,
        op10_wu_manber_decontamination,
        op11_trie_spelling_variants,
        op12_a_star_conversation_repair,
        op13_nn_descent_embedding_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op11_trie_spelling_variants": oracles.SPELLING,
    "op12_a_star_conversation_repair": oracles.CONVERSATIONS,
    "op13_nn_descent_embedding_dedup": oracles.VECTORS,
}
