"""The corpus pipeline: toxicity, quality rules, near duplicates, repeated strings, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents. A stage first deletes what earlier stages called so have materialised and
its input does not read; a stage's result is to be written before the next stage is called.

- toxicity: documents that the model of the table ``labels`` finds toxic go.
- quality rules: documents that fail a rule, or whose host is rejected, go.
- near duplicates: of each class of documents with linked five-word n-grams the smallest id stays.
- repeated strings: bytes under a 200-byte string that also starts elsewhere go from the texts
  (an incomplete character at a cut goes too); n_chars follows. A document of which nothing is left stays, empty.
- packing: documents are cut into sequences of 2048 tokens.
"""

from __future__ import annotations

import uuid
from functools import wraps

from tempora.llm import bpe, near_duplicates, packing, quality_rules, suffixes, toxicity
from tempora.llm.common import materialize, scope

#: No stage but the second can be expressed in SQL.
ORACLE_SQL = None


_running: list[str] = []


def _stage(function):
    @wraps(function)
    def run_stage(spark, docs, sf_dir):
        with scope(_running[-1] if _running else "stages", docs):
            return function(spark, docs, sf_dir)

    return run_stage


@_stage
def drop_toxic(spark, docs, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.filter_toxic(docs, toxicity.fit(docs, labels))


@_stage
def drop_low_quality(spark, docs, sf_dir):
    return quality_rules.keep(docs)


@_stage
def drop_near_duplicates(spark, docs, sf_dir):
    return near_duplicates.keep_one(docs)


@_stage
def drop_repeated_strings(spark, docs, sf_dir):
    return suffixes.rewrite(docs)


@_stage
def pack_documents(spark, docs, sf_dir):
    import public_tokenizers

    ranks = bpe.read_rank_file(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    added = packing.read_added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(docs, ranks, public_tokenizers.PATTERN, with_ids=False, added=added)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_strings),
    ("packing", pack_documents),
]


def run(spark, sf_dir):
    """All stages over the table documents, each written to the shared folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _running.append(f"run-{uuid.uuid4().hex}")
    try:
        for name, stage in STAGES:
            docs = stage(spark, docs, sf_dir)
            if name != STAGES[-1][0]:
                docs = materialize(docs)
        return docs
    finally:
        _running.pop()
