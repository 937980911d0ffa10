"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import chat_format, jaccard_join, mixing, substring_dedup, suffix_dedup, url_filter
from .chat_format import op7_chat_format
from .decontaminate import op3_decontaminate
from .jaccard_join import op5_jaccard_join
from .media import op4_media_columns
from .mixing import op9_mixing
from .quality import op2_quality
from .substring_dedup import op8_substring_dedup
from .suffix_dedup import op6_suffix_array_dedup
from .token_output import op10_token_output
from .url_filter import op1_url_filter

QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_quality, op3_decontaminate, op4_media_columns, op5_jaccard_join, op6_suffix_array_dedup,
        op7_chat_format, op8_substring_dedup, op9_mixing, op10_token_output,
    )
}
ORACLE_SQL = {
    "op1_url_filter": url_filter.ORACLE, "op5_jaccard_join": jaccard_join.ORACLE, "op6_suffix_array_dedup": suffix_dedup.ORACLE,
    "op7_chat_format": chat_format.ORACLE, "op8_substring_dedup": substring_dedup.ORACLE, "op9_mixing": mixing.ORACLE,
}
