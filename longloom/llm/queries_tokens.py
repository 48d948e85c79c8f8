"""Query of the token-id shards (no SQL form: the test compares with encoding each text at once)."""

from __future__ import annotations

from . import token_binary
from .common import read
from .registry import register


@register("op9_token_binary")
def op9_token_binary(spark, sf_dir):
    """Token ids of all documents, written as Simple-8b shards and read back."""
    return token_binary.token_table(read(spark, sf_dir, "documents"))
