"""A training-data pipeline over documents: language, near-duplicates, personal data, mixing, tokens.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents; the last returns the token ids of each document of the
mix. Documents that the mix takes several times come several times.

Defined cases: null and empty texts, and those without letters, go with the first stage; equal rows become one, and rows
without doc_id stay; a null source is a source of its own; ties in the mix follow a hash of the document; texts of any
length are taken whole, but for the copy at the end of a source's target, of which the mix takes the leading words that
are left; extra columns stay up to the last stage, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe.llm import bpe, language, mixing, ngram_join, pii
from mendframe.llm.queries import tokenizer_path
from mendframe.llm.shared import materialise

VOCABULARY = "byte_bpe_50k.json"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text reads as one of the labelled languages."""
    return language.accepted(docs, language.fit(language.sample_chunks(docs)))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id."""
    return ngram_join.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in them replaced by its kind."""
    return pii.redact(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return mixing.repeat_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and tokens of every document that the mix takes."""
    return bpe.encode(docs, tokenizer_path(VOCABULARY)).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens")


STAGES = [
    ("language", known_language),
    ("near duplicates", distinct_documents),
    ("personal data", without_personal_data),
    ("mixing", mixed_sources),
    ("tokens", token_ids),
]

#: the mix draws by a hash that SQL can say, but language models and tokens are beyond it
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over all documents; stages in between are written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, "pipeline")
    return docs
