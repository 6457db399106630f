"""From documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import discard, settled
from quire.llm.decontaminate import decontaminated
from quire.llm.langid import fit, recognised
from quire.llm.mixing import mix
from quire.llm.neardup import drop_near_duplicates
from quire.llm.queries import tokenizer_path
from quire.llm.tokens import token_digests


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised.

    Null texts, texts without a letter and those with a score under 0.5 go. Repeated rows have one verdict, rows
    without doc_id are judged like others but not learned from; without labelled rows, or rows, none stay.
    """
    return recognised(docs, fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id.

    Null and empty texts are no copies; rows without doc_id stay; of rows that repeat doc_id and text one stays.
    """
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passages: a twentieth of their words or more.

    Null and empty texts stay, repeated rows have one verdict, and an empty benchmark takes nothing.
    """
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source. A source without words, as of null and empty texts, gets no words; its rows count by
    their hash as others do. Repeated rows are in or out together.
    """
    return mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids that were written: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id alone; repeated rows each have a row; rows without doc_id come first.
    """
    return token_digests(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("token_output", token_output),
]

#: Signatures, training and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. Any column may be null, and documents may have more columns, of any name; no
    rows give no rows. What a stage leaves in the shared folder goes when the next one has read it."""
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = settled(spark, lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
        discard(*held)
        held = [docs]
    digests = STAGES[-1][1](spark, docs, sf_dir)
    discard(*held)
    return digests
