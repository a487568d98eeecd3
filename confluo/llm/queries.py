"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import documents

#: Vocabulary files by name; the folder is a parameter of the installation, see tokenizer_path().
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(documents(spark, sf_dir), tokenizer_path())


def op3_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .compact import classes

    return classes(documents(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenfile import written_and_read

    return written_and_read(documents(spark, sf_dir), tokenizer_path(), end_id=1)


def op5_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import written_and_read

    found = written_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op1_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .syncmers import edited

    return edited(documents(spark, sf_dir))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import linked

    return linked(documents(spark, sf_dir), k=4, percent=85)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_id

    return language_id(documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import digests

    return digests(documents(spark, sf_dir))


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import overlaps

    return overlaps(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(documents(spark, sf_dir), tokenizer_path())


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import digests

    return digests(documents(spark, sf_dir))


def op13_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .branch_merge import digests, merge

    return digests(merge(documents(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity_fm, op2_bpe_stream, op3_compact_windows, op4_token_files, op5_warc_archives, op6_syncmer_fingerprints, op7_ngram_jaccard, op8_language_id, op9_suffix_dedup, op10_spaced_seeds, op11_token_counts, op12_fill_in_middle, op13_branch_merge)}


def oracle_sql() -> dict[str, str]:
    from . import oracles

    return {
        "op5_warc_archives": oracles.WARC,
        "op7_ngram_jaccard": oracles.JACCARD,
        "op9_suffix_dedup": oracles.REPEATS,
        "op10_spaced_seeds": oracles.LEAKS,
        "op12_fill_in_middle": oracles.FILL_MIDDLE,
        "op13_branch_merge": oracles.MERGE,
    }
