"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat import ORACLE as OP11_SQL
from .chat import op11_chat_format
from .encode import op3_bpe
from .merkle import op9_fingerprints
from .mixing import ORACLE as OP6_SQL
from .mixing import op6_mixing
from .periodic import op13_periodic_runs
from .quality import ORACLE as OP7_SQL
from .quality import op7_quality_rules
from .repair import ORACLE as OP12_SQL
from .repair import op12_conversation_repair
from .sharding import op2_sharding
from .simhash import op4_simhash
from .substrings import op5_substring_dedup
from .suffix_array import op8_suffix_array
from .token_counts import op10_token_counts
from .urls import ORACLE as OP1_SQL
from .urls import op1_url_filters

QUERIES = {f.__name__: f for f in (op1_url_filters, op2_sharding, op3_bpe, op4_simhash, op5_substring_dedup, op6_mixing, op7_quality_rules, op8_suffix_array, op9_fingerprints, op10_token_counts, op11_chat_format, op12_conversation_repair, op13_periodic_runs)}
ORACLES: dict[str, str] = {"op1_url_filters": OP1_SQL, "op6_mixing": OP6_SQL, "op7_quality_rules": OP7_SQL, "op11_chat_format": OP11_SQL, "op12_conversation_repair": OP12_SQL}
