"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet to the shared folder and read
again as the next stage's documents. All but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.llm import bpe, decontaminate, langid, ngram_join, suffix
from confluo.llm.common import documents, written
from confluo.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Least mean probability of a document's language over its positions.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which the network sees no language: none has LEAST_SCORE of the probability, or there is no letter.

    Null and empty texts go. Every row is judged by its own text, so repeated rows stay or go together, and rows without a
    doc_id are judged as well. With fewer than two languages in the table only texts without a letter go.
    """
    found = langid.with_prediction(docs, langid.train(docs), names=("_lang_pred", "_score"))
    return found.where((F.col("_lang_pred") != langid.UNKNOWN) & (F.col("_score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each component of documents that share 85 % of their 4-word shingles.

    Rows without a doc_id are of no component and stay; so do documents without a word. Rows that share a doc_id stay or go
    together, by the one with the smallest text.
    """
    keep = ngram_join.linked(docs).where("component_id = doc_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").select(*docs.columns)
    return kept.union(docs.where("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut every byte of strings of 100 bytes that stand earlier too; half characters at the cuts go as well.

    Documents of which nothing but white space is left go. Rows without a doc_id are kept whole; of rows that share one,
    that with the smallest text stays. Whole texts, with null ones, keep their n_chars; those cut get the new length.
    """
    rows = suffix.without_repeats(docs, prefix="_cut_")
    whole = F.col("_cut_n_removed") == 0
    text = F.when(whole, F.col("text")).otherwise(F.col("_cut_kept_text"))
    rows = rows.withColumn("text", text).withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text")))
    return rows.where(whole | (F.trim("text") != "")).select(*docs.columns)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item or much of one.

    Null texts hold none. Rows without a doc_id are judged by no item and stay; rows that share one go together.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and decode what is left: doc_id, n_tokens and the digests of ids and decoded text, for every row.

    Null texts have no tokens.
    """
    return bpe.round_trip(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", contaminated),
    ("bpe_encoding", tokens),
]

#: A recurrent network, byte strings of half characters and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
