"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .context_tree import op10_context_tree
from .hosts import ORACLE as HOSTS_SQL
from .hosts import op12_host_rank
from .jaccard import ORACLE as JACCARD_SQL
from .jaccard import op5_ngram_jaccard
from .packing import op8_best_fit
from .pieces import op7_piece_codec
from .quality import op2_quality_nbsvm
from .runs import op13_cover_runs
from .secrets import op9_secret_network
from .substrings import ORACLE as SUBSTRINGS_SQL
from .substrings import op6_block_anchors
from .token_orc import op1_token_orc
from .vectors import ORACLE as VECTORS_SQL
from .vectors import op3_prefix_forest, op4_pca_tiles
from .whitening import op11_chebyshev_whitening

QUERIES = {f.__name__: f for f in (op1_token_orc, op2_quality_nbsvm, op3_prefix_forest, op4_pca_tiles, op5_ngram_jaccard, op6_block_anchors, op7_piece_codec, op8_best_fit, op9_secret_network, op10_context_tree, op11_chebyshev_whitening, op12_host_rank, op13_cover_runs)}
ORACLE_SQL: dict[str, str] = {"op4_pca_tiles": VECTORS_SQL, "op5_ngram_jaccard": JACCARD_SQL, "op6_block_anchors": SUBSTRINGS_SQL, "op12_host_rank": HOSTS_SQL}
