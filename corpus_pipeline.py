"""The corpus pipeline: each stage works on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from larkspur.llm import bpe_codec, line_dedup, mixing, ngram_join, quality_rules
from larkspur.llm.store import cut
from pyspark.sql import functions as F


def _rules(spark, docs, sf_dir):
    """Documents that the rules reject go."""
    return quality_rules.filter_documents(docs)


def _counted(docs):
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def _lines(spark, docs, sf_dir):
    """Repeated lines go, and with them documents that have no line of their own; n_chars follows the text."""
    return _counted(line_dedup.dedup(docs))


def _join(spark, docs, sf_dir):
    """Of each group of similar documents the one with the smallest id stays."""
    return ngram_join.keep_one(docs)


def _mix(spark, docs, sf_dir):
    """Documents are sampled by their calibrated probabilities."""
    return mixing.sample(docs)


def _encode(spark, docs, sf_dir):
    """Token ids of the texts, with digests of ids and of the decoded text."""
    import public_tokenizers

    keep = ("doc_id", "lang", "source", "n_chars")
    return bpe_codec.digest(docs, public_tokenizers.path("byte_bpe_50k.json"), keep)


STAGES = [
    ("quality rules", _rules),
    ("line dedup", _lines),
    ("n-gram Jaccard join", _join),
    ("mixing sources", _mix),
    ("BPE encoding", _encode),
]

#: Fuzzy lines and token ids are beyond SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
