"""Packing of texts that hold the added token, against the tokenizers file with its default settings."""

import zlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from tempora.llm import queries as Q

TEXTS = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|><|endoftext|>b  <|endoftext|>\n c", "<|endoftext| <|endof", "no token here", "", None]


def test_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    assert want[0] == [31373, 220, 50256, 995, 1]
    for found in (Q.QUERIES["op8_packing"](spark, str(tmp_path)), corpus_pipeline.pack_documents(spark, docs, str(tmp_path))):
        got = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in found.collect()}
        assert got == {i: (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in want.items()}


def test_two_vocabularies_in_one_session(spark):
    """Workers are kept; each vocabulary gives its own ids, though both have as many entries and begin alike."""
    import tiktoken

    from tempora.llm import bpe, packing

    texts = ["naïve 東京 text with many words", "größer"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for name in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"):
        ranks = bpe.read_rank_file(spark, public_tokenizers.path(name))
        library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        got = {r.doc_id: r.doc_tokens for r in packing.pack(docs, ranks, public_tokenizers.PATTERN).collect()}
        assert got == {i: len(library.encode_ordinary(t)) + 1 for i, t in enumerate(texts)}
