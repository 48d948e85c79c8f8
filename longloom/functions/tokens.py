"""Tokenizing and token-array column functions.

The default tokenizer is a lossless regular expression evaluated by Catalyst:
runs of non-space, non-period characters, single periods, and runs of
whitespace.  Joining the tokens gives back the text exactly, so decoding is
``array_join``.  Token ids are the first 28 bits of the md5 of the token.

:class:`PatternTokenizer` makes the same ids in Arrow batches, where a word that
comes again is hashed once.  Any other tokenizer plugs in through
:class:`ArrowTokenizer`, an Arrow batched ``pandas_udf`` that loads the model
once per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .worker import arrow_parts, worker_state

TOKEN_PATTERN = r"[^ \t\n\r.]+|[.]|[ \t\n\r]+"
# A period token of the default tokenizer.
PERIOD_TOKENS = ["."]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokenize(text: Column | str) -> Column:
    """array<string> of tokens; empty array for empty text, null for null."""
    return F.regexp_extract_all(_c(text), F.lit(TOKEN_PATTERN), F.lit(0))


def token_id(tok: Column) -> Column:
    return F.conv(F.substring(F.md5(tok), 1, 7), 16, 10).cast("int")


def token_ids(tokens: Column | str) -> Column:
    """array<int> ids of a token array."""
    return F.transform(_c(tokens), token_id)


def detokenize(tokens: Column | str, limit: Column | int | None = None) -> Column:
    """Text of the first ``limit`` tokens (all when None)."""
    t = _c(tokens)
    if limit is not None:
        lim = limit if isinstance(limit, Column) else F.lit(limit)
        t = F.slice(t, 1, F.least(lim, F.size(t)).cast("int"))
    return F.array_join(t, "")


def token_count(tokens: Column | str) -> Column:
    return F.size(_c(tokens))


def trim_tokens(tokens: Column | str, n: Column | int) -> Column:
    """First ``n`` tokens (all of them when shorter)."""
    t = _c(tokens)
    nn = n if isinstance(n, Column) else F.lit(n)
    return F.when(F.size(t) > nn, F.slice(t, 1, nn.cast("int"))).otherwise(t)


def trim_chars(text: Column | str, context_length: int | Column, chars_per_token: float | None = None) -> Column:
    """First ``int(context_length * chars_per_token)`` characters (the character-estimate cut of a
    haystack; 3.66 characters per token by default)."""
    from ..constants import HAYSTACK_CHARS_PER_TOKEN
    r = chars_per_token if chars_per_token is not None else HAYSTACK_CHARS_PER_TOKEN
    n = context_length if isinstance(context_length, Column) else F.lit(context_length)
    return F.substring(_c(text), F.lit(1), (n * F.lit(r)).cast("int"))


def truncate_middle(x: Column | str, m: Column | int) -> Column:
    """Keep the first and last ``m // 2`` items when longer than ``m``.

    Odd ``m`` keeps ``m - 1`` items.  ``m < 2`` keeps the first ``m`` items (the
    list form of the original returns the whole list for m=1; that is a slicing
    accident, declared as a deviation).
    """
    a = _c(x)
    mm = m if isinstance(m, Column) else F.lit(m)
    h = F.floor(mm / 2).cast("int")
    body = F.when(mm < 2, F.slice(a, 1, F.greatest(mm, F.lit(0)).cast("int"))).otherwise(
        F.concat(F.slice(a, 1, h), F.slice(a, -h, h)))
    return F.when(F.size(a) <= mm, a).otherwise(body)


def truncate_middle_exact(x: Column | str, m: Column | int) -> Column:
    """Keep ``m // 2`` leading and ``ceil(m / 2)`` trailing items: exactly ``m``."""
    a = _c(x)
    mm = m if isinstance(m, Column) else F.lit(m)
    left = F.floor(mm / 2).cast("int")
    right = (mm - left).cast("int")
    body = F.when(right <= 0, F.slice(a, 1, left)).otherwise(
        F.concat(F.slice(a, 1, left), F.slice(a, -right, right)))
    return F.when(F.size(a) <= mm, a).otherwise(body)


def truncate_text(text: Column | str, max_tokens: Column | int) -> Column:
    """Tokenize, cut the middle out, decode."""
    return detokenize(truncate_middle(tokenize(text), max_tokens))


def right_aligned_windows(n: Column | str, step: int) -> Column:
    """Pre-fill windows over ``n`` items: boundaries n-1, n-1-step, ... (all > 0), then 0.

    Returns array<struct<lo int, hi int>> in ascending order; the first window
    is the short one.
    """
    nn = _c(n).cast("int")
    top = nn - 1
    cnt = F.when(top > 0, F.floor((top - 1) / step).cast("int") + 1).otherwise(F.lit(0))
    empty = F.array().cast("array<int>")
    desc = F.when(cnt > 0, F.sequence(F.lit(0), cnt - 1)).otherwise(empty)
    bounds = F.concat(F.array(F.lit(0)), F.reverse(F.transform(desc, lambda i: top - i * step)))
    idx = F.when(F.size(bounds) > 1, F.sequence(F.lit(1), F.size(bounds) - 1)).otherwise(empty)
    return F.transform(idx, lambda i: F.struct(F.element_at(bounds, i).alias("lo"),
                                               F.element_at(bounds, i + 1).alias("hi")))


class ArrowTokenizer:
    """Adapter for any Python tokenizer.

    ``factory()`` returns ``encode(str) -> list[int]``, or with ``batched=True``
    ``encode(list[str]) -> list[list[int]]``.  It is called once per Python worker (the result is kept
    across tasks under ``name``) and applied to Arrow batches.
    """

    def __init__(self, name: str, factory: Callable[[], Callable], batched: bool = False):
        self.name = name
        self.factory = factory
        self.batched = batched

    def ids(self, text: Column | str) -> Column:
        name, factory, batched = self.name, self.factory, self.batched

        def encode_all(batches):
            held = worker_state().setdefault("tokenizers", {})
            if name not in held:
                held[name] = factory()
            enc = held[name]
            for s in batches:
                null = s.isna()
                texts = s.where(~null, "").tolist()
                ids = enc(texts) if batched else [enc(x) for x in texts]
                yield pd.Series([None if n else list(i) for i, n in zip(ids, null)], dtype=object)

        encode_all.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(encode_all, T.ArrayType(T.IntegerType()))(_c(text))


# Bytes of text worked on at once: words that come again are hashed once in them.
PATTERN_BYTES = 8 << 20


def _pattern_ids(texts: pa.Array) -> pa.Array:
    """``array<int>`` of ids for an Arrow array of texts, null for null.

    The pattern's classes (spaces, periods, the rest) are single bytes in UTF-8 and its tokens cover the
    text, so tokens are runs of one class (a period is one of its own) and slices of the texts' buffer."""
    from hashlib import md5

    import numpy as np
    null = texts.is_null()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2].slice(at[0], at[-1] - at[0]) if at[-1] > at[0] else pa.py_buffer(b"")
    at = at.astype(np.int64) - at[0]
    of = np.zeros(256, np.uint8)
    of[list(b" \t\n\r")], of[ord(".")] = 1, 2
    kind = of[np.frombuffer(data, np.uint8)]
    first = np.ones(len(kind), bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    first[at[at < len(kind)]] = True
    start = np.flatnonzero(first)
    ends = np.append(start, len(kind)).astype(np.int64)
    tokens = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), data]).dictionary_encode()
    words = tokens.dictionary.to_numpy(zero_copy_only=False)
    sums = b"".join([md5(w, usedforsecurity=False).digest()[:4] for w in words])
    ids = (np.frombuffer(sums, ">u4") >> 4).astype(np.int32)
    flat = ids[tokens.indices.to_numpy()]
    upto = pa.array(np.searchsorted(start, at), pa.int32())
    return pa.ListArray.from_arrays(upto, pa.array(flat, pa.int32()), mask=null)


class PatternTokenizer:
    """The default tokenizer as a plug-in: the ids of ``token_ids(tokenize(text))``."""

    def ids(self, text: Column | str) -> Column:
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for texts in arrow_parts(batches, PATTERN_BYTES):
                yield _pattern_ids(texts)

        # invalid bytes are read as Java reads them
        valid = F.when(F.is_valid_utf8(_c(text)), _c(text)).otherwise(detokenize(tokenize(text)))
        return F.arrow_udf(encode, T.ArrayType(T.IntegerType()))(valid)
