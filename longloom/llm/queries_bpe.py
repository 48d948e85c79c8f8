"""Query of the BPE encoder and decoder (no SQL form: the test compares with the tokenizer itself)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chunk_bpe
from .common import read
from .registry import register


@register("op12_chunk_bpe")
def op12_chunk_bpe(spark, sf_dir):
    """Token ids of all documents and the text that they decode to, as digests."""
    r = chunk_bpe.encode_decode(read(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                    F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
