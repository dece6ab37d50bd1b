"""The corpus pipeline: language ID, one document of each near-duplicate group, the mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the
next one's docs. All but the last return the columns of documents. The language model's training, the
join's shingles, the rounding and the tokens are no SQL, so there is none; the tests hold every stage
against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioforge.llm.common import written
from folioforge.llm.jaccard import one_of_each
from folioforge.llm.langid import accepted
from folioforge.llm.mixing import mixed_documents
from folioforge.llm.packing import added_tokens, pack


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model does not reject.

    It learns from the labelled ones among ``docs``. Null text, or text without a letter, goes, and so does all where no row
    is labelled; repeated rows all stay or all go; an empty table stays empty; other columns, of any type and name, are
    carried along.
    """
    return accepted(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of the documents that five-word shingles link at 0.8, the one with the smallest id.

    Null text counts as empty, and documents without words all stay; null is the largest id; of rows of one id and text the
    smallest stays, compared by all columns, those without an order of their own as JSON; other columns are carried along.
    """
    return one_of_each(docs, k=5, similarity=(80, 100))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: weights 5, 2, 1 by source, at most three times a source's size.

    A null source is one of its own, the last; null text has size 0; of a source without words nothing is taken; equal
    rows share their copies; an empty table stays empty; other columns are carried along.
    """
    return mixed_documents(docs, weights=(5, 2, 1), cap=3.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens.

    Null text is empty and gives the one id that ends a document; repeated rows are documents of their own; very long texts
    are cut into pieces; an empty table gives no rows; other columns are not read.
    """
    import public_tokenizers

    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, added=added)


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", one_of_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
