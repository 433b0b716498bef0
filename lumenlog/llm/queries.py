"""The registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from lumenlog.llm.embeddings import OP5_SQL, op5_embedding_near_dedup
from lumenlog.llm.fingerprints import op7_fingerprints
from lumenlog.llm.html import op8_html_extraction
from lumenlog.llm.lines import op9_line_dedup
from lumenlog.llm.minhash import OP2_SQL, op2_minhash_near_dedup
from lumenlog.llm.mixing import OP10_SQL, op10_mixing
from lumenlog.llm.packing import op3_token_output, op6_cost_balanced_packing
from lumenlog.llm.pii import op13_personal_data
from lumenlog.llm.quality import op4_quality_classifier
from lumenlog.llm.suffix_tree import op1_suffix_tree_scoring
from lumenlog.llm.trie import OP12_SQL, op12_prefix_trie
from lumenlog.llm.whitening import op11_whitening

QUERIES = {
    "op1_suffix_tree_scoring": op1_suffix_tree_scoring,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_token_output": op3_token_output,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_cost_balanced_packing": op6_cost_balanced_packing,
    "op7_fingerprints": op7_fingerprints,
    "op8_html_extraction": op8_html_extraction,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
    "op11_whitening": op11_whitening,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_personal_data": op13_personal_data,
}

ORACLES = {"op2_minhash_near_dedup": OP2_SQL, "op5_embedding_near_dedup": OP5_SQL, "op10_mixing": OP10_SQL, "op12_prefix_trie": OP12_SQL}
