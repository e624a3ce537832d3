"""Queries of this subpackage by name, and SQL where SQL can express them."""

from __future__ import annotations

from .compression import op6_zstd_dictionaries
from .decontamination import op3_suffix_automaton
from .hard_negatives import op13_residue_gemm
from .html_extraction import op9_tree_scoring
from .jaccard_join import op7_combination_prefixes
from .language_id import op8_word_first_backoff
from .licenses import op5_rare_token_index
from .mixing import op2_pivotal_rounding
from .perplexity import op4_kneser_ney_bands
from .pii import op11_anchor_expansion
from .sharding import op10_sampled_splitters
from .sql import ORACLE_SQL
from .token_alignment import op12_fragment_monoid
from .warc import op1_linked_derivatives

__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (
        op1_linked_derivatives,
        op2_pivotal_rounding,
        op3_suffix_automaton,
        op4_kneser_ney_bands,
        op5_rare_token_index,
        op6_zstd_dictionaries,
        op7_combination_prefixes,
        op8_word_first_backoff,
        op9_tree_scoring,
        op10_sampled_splitters,
        op11_anchor_expansion,
        op12_fragment_monoid,
        op13_residue_gemm,
    )
}
