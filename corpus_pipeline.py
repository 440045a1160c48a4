"""The corpus pipeline: documents without toxic ones, cleaned, without near copies, mixed, and encoded.

Every stage is one operator applied to all documents that the stage before it kept. Stages but the
last return the columns of ``documents``:

* toxicity: documents which the classifier chain finds toxic go;
* quality: documents which the line-first rules reject go; of the others, lines that fail go;
* neardup: of documents linked by a Jaccard similarity of 0.8 or more on 5-word shingles, found by the trie join of
  their SimHash fingerprints, that of the least id stays;
* mixing: a row for each time that a document, or a part of it, is taken by the mix;
* sentencepiece: doc_id, n_tokens, ids_crc32, round_trip and ids of every row.

An empty table passes all stages; a null text is no toxic document, and fails the quality rules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from seedflow.llm import mixing, quality, sentencepiece_bpe, simhash, toxicity
from seedflow.llm.common import checkpoint_table, load


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, load(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.clean_documents(docs)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity_stage), ("quality", quality_stage), ("neardup", neardup_stage), ("mixing", mixing_stage), ("sentencepiece", sentencepiece_stage)]

#: The fitted chain and the components of near copies have no SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = checkpoint_table(docs, f"pipeline-{name}")
    return docs
