"""Registered queries on a model's own tokens (a byte-level BPE file of the installed public set)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import model_tokens as M
from ..operators import haystack as H
from . import fixtures as FX
from .corpus import docs
from .registry import register


def tokenizer(name: str = "byte_bpe_50k.json") -> M.ModelTokenizer:
    import public_tokenizers
    return M.byte_level(public_tokenizers.path(name))


@register("model_decode", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def q_model_decode(spark, sf_dir):
    """Every document through subword ids and back."""
    tok = tokenizer()
    d = docs(spark, sf_dir).select("doc_id", tok.ids("text").alias("ids"))
    return d.select("doc_id", F.md5(tok.text("ids")).alias("text_md5"))


@register("model_cut", "SELECT doc_id, md5(text) AS text_md5, length(text) AS n_chars FROM documents")
def q_model_cut(spark, sf_dir):
    """Every document cut at the token in its middle: the two parts join to the text."""
    d = docs(spark, sf_dir).select("doc_id", "text", tokenizer().tokens("text").alias("t"))
    n = F.size("t.ids")
    half = F.floor(n / 2).cast("int")
    whole = F.concat(M.head_bytes("text", F.col("t"), half), M.tail_bytes("text", F.col("t"), n - half))
    return d.select("doc_id", F.md5(whole).alias("text_md5"), F.length(M.valid_text(whole)).cast("long").alias("n_chars"))


@register("model_truncate")
def q_model_truncate(spark, sf_dir):
    """Middle truncation on the model's tokens, both forms (no SQL form: tested against the tokenizer)."""
    d = docs(spark, sf_dir).select("doc_id", "text", tokenizer().tokens("text").alias("t"))
    return d.select("doc_id", F.size("t.ids").alias("n_tokens"),
                    F.md5(M.truncate_middle_text("text", F.col("t"), FX.TRUNCATE_M)).alias("cut_md5"),
                    F.md5(M.truncate_middle_text("text", F.col("t"), FX.TRUNCATE_M, exact=True)).alias("exact_md5"))


def model_cases(documents, tok: M.ModelTokenizer, needle: str, lengths, depths, max_len: int, group: str = "lang"):
    """Needle cells with their contexts, lengths and insertion points in the model's tokens."""
    d = documents.sparkSession.range(1).select(tok.ids(F.lit(needle)).alias("needle"), tok.ids(F.lit(".")).alias("period"))
    ids = d.first()
    h = H.haystacks(documents, max_len, group=group, order="doc_id", chars="n_chars", tokenizer=tok.sized)
    c = H.needle_cells(h, lengths, depths, len(ids.needle), group=group, period_tokens=list(ids.period))
    return H.materialize(c, h, needle, group=group, decode=tok.raw)


@register("model_needle_cases")
def q_model_needle_cases(spark, sf_dir):
    """The needle grid on model tokens (no SQL form: tested against the tokenizer)."""
    d = docs(spark, sf_dir).select("lang", "doc_id", "text", "n_chars")
    m = model_cases(d, tokenizer(), K.DEFAULT_NEEDLE, *H.default_axes(), K.CONTEXT_LENGTHS_MAX)
    return m.select("lang", "context_length", "depth_percent", "insert_at", "total_tokens", F.md5("context").alias("context_md5"))
