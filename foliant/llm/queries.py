"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .language import op3_language_id
from .line_dedup import OP4_SQL, op4_line_dedup
from .merge_dropout import op5_merge_dropout
from .mixing import op2_source_mix
from .quality import op1_quality_rules
from .sharding import OP6_SQL, op6_sharding
from .simhash import op8_simhash
from .token_store import op9_token_store
from .top_k import OP10_SQL, op10_top_k
from .warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mix": op2_source_mix,
    "op3_language_id": op3_language_id,
    "op4_line_dedup": op4_line_dedup,
    "op5_merge_dropout": op5_merge_dropout,
    "op6_sharding": op6_sharding,
    "op7_warc": op7_warc,
    "op8_simhash": op8_simhash,
    "op9_token_store": op9_token_store,
    "op10_top_k": op10_top_k,
}

ORACLES: dict[str, str] = {
    "op4_line_dedup": OP4_SQL,
    "op6_sharding": OP6_SQL,
    "op7_warc": OP7_SQL,
    "op10_top_k": OP10_SQL,
}
