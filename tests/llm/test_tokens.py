"""Ids against a plain tokenizer of the vocabulary."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from linkmill.llm import packing, rollup, tokens

TEXTS = ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|><|endoftext|>b \n<|endoftext|>", "<|endoftext", " <|endoftext|> " * 700, "it's 日本 \x00 1234", ""]


def plain(text):
    return Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["json", "tiktoken"])
def test_ids_are_those_of_a_plain_tokenizer(kind):
    encode = tokens.encoder(tokens.vocabulary(f"byte_bpe_50k.{kind}"))
    assert encode("x <|endoftext|> y").tolist() == [87, 220, 50256, 331]
    assert [encode(t).tolist() for t in TEXTS] == [plain(t) for t in TEXTS]


def test_a_vocabulary_without_special_tokens():
    assert tokens.encoder(tokens.vocabulary("byte_bpe_multi_50k.tiktoken"))("x <|endoftext|> y").dtype == np.dtype("<u4")


def test_pieces_and_counts_with_special_tokens(spark):
    docs = spark.createDataFrame([(i, t, "s", "l") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, lang string")
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packing.pack(docs).collect()}
    want = {}
    for d, t in enumerate(TEXTS):
        ids = np.array([*plain(t), packing.END], "<u4")
        first = len(ids) % packing.LIMIT or packing.LIMIT
        edges = [0, *range(first, len(ids) + 1, packing.LIMIT)]
        want |= {(d, i): (x, y - x, zlib.crc32(ids[x:y].tobytes())) for i, (x, y) in enumerate(zip(edges, edges[1:], strict=False))}
    assert got == want
    counts = rollup.token_counts(docs, tokens.vocabulary("byte_bpe_50k.tiktoken"), "v").collect()
    assert {r.doc_id: r.n_tokens for r in counts} == {d: len(plain(t)) for d, t in enumerate(TEXTS)}
