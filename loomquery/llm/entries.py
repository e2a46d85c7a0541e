"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from .decontaminate import op5_decontaminate
from .jaccard_join import op4_jaccard_join
from .language_id import op1_language_id
from .line_dedup import op10_line_dedup
from .packing import op2_packing
from .quality import op6_quality
from .secrets import op3_secrets
from .sharding import op9_sharding
from .topk_search import TOPK_SQL, op7_topk_search
from .url_filter import op8_url_filters

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_secrets": op3_secrets,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_decontaminate": op5_decontaminate,
    "op6_quality": op6_quality,
    "op7_topk_search": op7_topk_search,
    "op8_url_filters": op8_url_filters,
    "op9_sharding": op9_sharding,
    "op10_line_dedup": op10_line_dedup,
    "pipeline": corpus_pipeline.run,
}

#: DuckDB's SQL can express the exact search; it has no tokenizer, compressor, CRC-32, positions of matches or fitted
#: models, and the two joins over shingles and lines are too slow in it on whole tables.
ORACLE_SQL = {"op7_topk_search": TOPK_SQL}
