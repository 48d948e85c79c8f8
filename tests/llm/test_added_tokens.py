"""Token ids of texts that hold the string of an added token, against an untouched tokenizer."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from longloom.llm import token_binary

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "no added token", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext| >", "<|ENDOFTEXT|>",
         "end \n<|endoftext|>", "", "<|endoftext|> <s> [INST] it's don't"]


def _plain():
    return Tokenizer.from_file(token_binary._tokenizer_path(token_binary.TOKENIZER))


def test_added_tokens_in_texts():
    tok, enc = _plain(), token_binary.PieceEncoder(token_binary._tokenizer_path(token_binary.TOKENIZER))
    assert tok.encode(TEXTS[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    for texts in (TEXTS, TEXTS[::-1], TEXTS[:1], ["<|endoftext|>"] * 3):
        ids, per = enc.encode(texts)
        whole = [tok.encode(t, add_special_tokens=False).ids for t in texts]
        assert per.tolist() == [len(w) for w in whole] and ids.tolist() == [i for w in whole for i in w]


def test_token_table_with_added_tokens(spark):
    tok, at = _plain(), 0
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r, t in zip(token_binary.token_table(docs).orderBy("start").collect(), TEXTS, strict=True):
        ids = tok.encode(t, add_special_tokens=False).ids + [token_binary.END_ID]
        assert r.start == at and r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
