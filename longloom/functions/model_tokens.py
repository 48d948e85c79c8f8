"""A model's own tokens: ids with byte offsets, exact cuts, decoding.

A lossless tokenizer (byte-level BPE) splits the UTF-8 bytes of a text, so a token is an id and an end
offset in these bytes.  Texts are cut at token borders by byte offsets inside Catalyst; a border inside
a character leaves invalid bytes, which become U+FFFD as in the tokenizer's own decoding.  Python runs
only to encode (and to decode ids that have lost their text), the model loaded once per worker; an Arrow batch
is worked on in parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .worker import arrow_parts, worker_state


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def valid_text(raw: Column) -> Column:
    """Text of bytes; what is no UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(raw.cast("string"))


class ModelTokenizer:
    """Adapter of a lossless tokenizer.

    ``load()`` returns ``(encode, pieces)``: ``encode(list[str]) -> list[list[int]]`` and the bytes of
    every id.  It is called once per Python worker (kept across tasks under ``name``).
    """

    def __init__(self, name: str, load: Callable[[], tuple]):
        self.name, self.load = name, load

    def _held(self):
        name, load = self.name, self.load

        def get():
            held = worker_state().setdefault("models", {})
            if name not in held:
                held[name] = load()
            return held[name]
        return get

    def tokens(self, text: Column | str) -> Column:
        """``struct<ids, ends, sizes>`` (arrays of int): ids, their end offsets in the UTF-8 bytes and their
        byte lengths; null for null."""
        get = self._held()

        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            fn, pieces = get()
            size_of = np.fromiter(map(len, pieces), np.int32, len(pieces))
            for texts in arrow_parts(batches):
                ids = fn([t or "" for t in texts.to_pylist()])
                n = np.fromiter(map(len, ids), np.int64, len(ids))
                at = np.concatenate([[0], np.cumsum(n)])
                flat = np.fromiter(chain.from_iterable(ids), np.int32, int(at[-1]))
                sizes = size_of[flat]
                upto = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                before = upto[at[:-1]]
                if (upto[at[1:]] - before != pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)).any():
                    raise ValueError("the tokenizer is not lossless: its tokens do not cover the text")
                ends = (upto[1:] - np.repeat(before, n)).astype(np.int32)
                offsets = pa.array(at, pa.int32())
                yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (flat, ends, sizes)],
                                                 names=["ids", "ends", "sizes"], mask=texts.is_null())

        t = F.arrow_udf(encode, "struct<ids:array<int>,ends:array<int>,sizes:array<int>>")(_c(text))
        return F.when(_c(text).isNotNull(), t)

    def sized(self, text: Column | str) -> Column:
        """``array<struct<id int, n int>>``: ids with their byte lengths, the token form of haystacks."""
        return sized_tokens(self.tokens(text))

    def ids(self, text: Column | str) -> Column:
        return self.tokens(text)["ids"]

    def raw(self, ids: Column | str) -> Column:
        """Bytes of an array of ids."""
        get = self._held()

        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            _, pieces = get()
            for part in arrow_parts(batches):
                yield pa.array([None if x is None else b"".join([pieces[i] for i in x]) for x in part.to_pylist()], pa.binary())

        return F.arrow_udf(decode, "binary")(_c(ids))

    def text(self, ids: Column | str) -> Column:
        """Text of an array of ids (special tokens by their name)."""
        return valid_text(self.raw(ids))


def byte_level(path: str) -> ModelTokenizer:
    """A byte-level BPE file of the ``tokenizers`` library."""
    def load():
        import json
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        with open(path, encoding="utf-8") as f:
            special = {t["id"]: t["content"] for t in json.load(f)["added_tokens"]}
        # a byte-level vocabulary writes a byte as one character: printable Latin-1 as itself, the
        # other bytes, in order, as the characters from 256 on
        printable = [b for b in range(256) if chr(b).isprintable() and b != 0x20 and b != 0xAD]
        other = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(other)}
        pieces = [special[i].encode() if i in special else bytes(byte[c] for c in tok.id_to_token(i))
                  for i in range(tok.get_vocab_size())]
        return lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)], pieces
    return ModelTokenizer(f"byte-level:{path}", load)


# ------------------------------------------------------------------ cuts (no Python)

def sized_tokens(t: Column) -> Column:
    """Ids with their byte lengths.  No lambda function: Spark allows none around a Python function."""
    return F.arrays_zip(t["ids"], t["sizes"]).cast("array<struct<id:int,n:int>>")


def _end(t: Column, n: Column) -> Column:
    """Byte offset after the first ``n`` tokens."""
    return F.when(n <= 0, F.lit(0)).otherwise(F.coalesce(F.get(t["ends"], F.least(n, F.size(t["ends"])).cast("int") - 1), F.lit(0)))


def _n(n) -> Column:
    return n if isinstance(n, Column) else F.lit(n)


def head_bytes(text: Column | str, t: Column, n) -> Column:
    return F.substring(_c(text).cast("binary"), F.lit(1), _end(t, _n(n)))


def tail_bytes(text: Column | str, t: Column, n) -> Column:
    """Bytes of the last ``n`` tokens."""
    raw = _c(text).cast("binary")
    start = _end(t, F.size(t["ends"]) - _n(n))
    return F.when(_n(n) <= 0, F.lit(b"")).otherwise(F.substring(raw, start + 1, F.octet_length(raw) - start))


def head(text: Column | str, t: Column, n) -> Column:
    """Text of the first ``n`` tokens (all of it when there are fewer)."""
    return valid_text(head_bytes(text, t, n))


def tail(text: Column | str, t: Column, n) -> Column:
    """Text of the last ``n`` tokens."""
    return valid_text(tail_bytes(text, t, n))


def truncate_middle_text(text: Column | str, t: Column, m, exact: bool = False) -> Column:
    """Cut the middle out: the first and last ``m // 2`` tokens (``exact``: ``m`` in all) of a text with
    more than ``m``.  ``m < 2`` keeps the first ``m``, as for arrays."""
    m = _n(m)
    left = F.floor(m / 2).cast("int")
    right = (m - left).cast("int") if exact else left
    cut = F.concat(head(text, t, left), tail(text, t, right))
    if not exact:
        cut = F.when(m < 2, head(text, t, m)).otherwise(cut)
    return F.when(F.size(t["ids"]) <= m, _c(text)).otherwise(cut)
