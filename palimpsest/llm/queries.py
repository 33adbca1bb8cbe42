"""The queries and oracle SQL of this subpackage."""

from __future__ import annotations

from .chat_format import chat_query
from .decontaminate import leaks_query
from .html_text import pages_query
from .language_id import language_query
from .mixing import mixing_query
from .near_dup import near_dup_query
from .quality_rules import QUALITY_SQL, quality_query
from .secret_scan import secrets_query
from .substring_dedup import substring_query
from .toxicity import toxicity_query

QUERIES = {
    "op1_mixing": mixing_query,
    "op2_substring_dedup": substring_query,
    "op3_decontaminate": leaks_query,
    "op4_chat_format": chat_query,
    "op5_language_id": language_query,
    "op6_toxicity": toxicity_query,
    "op7_html_text": pages_query,
    "op8_secret_scan": secrets_query,
    "op9_quality_rules": quality_query,
    "op10_near_dup": near_dup_query,
}
ORACLE_SQL = {"op9_quality_rules": QUALITY_SQL}
