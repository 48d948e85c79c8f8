"""All queries of the subpackage (importing this module fills its registry)."""

from __future__ import annotations

from . import queries_arc, queries_bpe, queries_chat, queries_decontam, queries_dedup, queries_mixing, queries_negatives, queries_quality, queries_search, queries_secrets, queries_suffix, queries_tokens, queries_url  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
