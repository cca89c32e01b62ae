"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .alignment import op12_alignment
from .bpe import op11_bpe
from .embedding_dedup import OP5_SQL, op5_embedding_near_dedup
from .html_extract import op9_html_main_text
from .licences import OP10_SQL, op10_licence_scan
from .mixing import op7_mixing
from .packing import op4_best_fit_packing
from .prefix_trie import op13_prefix_trie
from .quality import op1_quality
from .simhash import op3_simhash_near_dedup
from .token_files import op6_token_files
from .topk import OP2_SQL, op2_exact_topk
from .toxicity import op8_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality,
        op2_exact_topk,
        op3_simhash_near_dedup,
        op4_best_fit_packing,
        op5_embedding_near_dedup,
        op6_token_files,
        op7_mixing,
        op8_toxicity,
        op9_html_main_text,
        op10_licence_scan,
        op11_bpe,
        op12_alignment,
        op13_prefix_trie,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op2_exact_topk": OP2_SQL,
    "op5_embedding_near_dedup": OP5_SQL,
    "op10_licence_scan": OP10_SQL,
}
