"""Token counts from a cache of digests.

A stored count belongs to the digest of a normalised content and to the digest of a tokenizer's version. Rows are joined
to the cache by these digests, only distinct contents that it lacks are encoded, and their counts are appended to it, so the
next run over the same or a grown corpus encodes what is new. Digests travel through the joins; a text is moved once, for
the one row that stands for a missing content.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, tune, written
from .tokenfile import library_encoder

SCHEMA = "content binary, n_tokens long, tokenizer string"
#: Tokens above which a text is marked as too long for a context.
LIMIT = 2048
#: A content is frequent if more than one of so many rows has it; there are fewer frequent contents than that.
FREQUENT = 1000
#: Missing contents up to this number, of 48 bytes each, are broadcast to the texts; more are joined by a shuffle.
FEW_MISSES = 50_000
#: Characters that are encoded at once, and pieces of long texts that are counted one by one.
BATCH_CHARS = 1 << 20


class Version(NamedTuple):
    """A tokenizer file, its digest together with that of the library, and which changes of a text it cannot see."""

    path: str
    digest: str
    folds: bool
    starts: str  # first characters of special tokens, whose case counts


def version(path: str) -> Version:
    """``folds`` says that the file drops white space between words, composes before it lower-cases, and knows no other rule."""
    with open(path, "rb") as f:
        raw = f.read()
    if path.endswith(".model"):
        import sentencepiece as library

        folds, starts = False, ""
    else:
        import tokenizers as library

        spec = json.loads(raw)
        normal = (spec.get("normalizer") or {}).get("normalizers", [])
        split = [p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if p["type"] == "Split"]
        known = [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"] and normal[1].get("pattern") == {"Regex": r"\s+"} and normal[1].get("content") == " "
        folds = known and len(split) == 1 and split[0]["invert"] and split[0]["behavior"] == "Removed" and r"[^\s" in split[0]["pattern"].get("Regex", "")
        tokens = spec.get("added_tokens", [])
        folds = folds and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in tokens)
        starts = "".join(sorted({t["content"][0] for t in tokens}))
    library_version = f"{library.__name__} {library.__version__}"
    return Version(path, hashlib.sha256(raw + library_version.encode()).hexdigest(), folds, starts)


def normalised(text: Column, tokenizer: Version) -> Column:
    """A text that has the same tokens; a null text is empty.

    Where the tokenizer folds, runs of ASCII white space become one space and those at the ends go. Texts of ASCII alone that
    hold no start of a special token become lower case; in others a capital may compose with a mark only after that.
    """
    text = F.coalesce(text, F.lit(""))
    if not tokenizer.folds:
        return text
    spaced = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    plain = F.octet_length(text) == F.char_length(text)
    for c in tokenizer.starts:
        plain = plain & ~F.contains(text, F.lit(c))
    return F.when(plain, F.lower(spaced)).otherwise(spaced)


class Cache:
    """A Parquet table of counts, in one folder per tokenizer version, to which runs append."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(path)

    def counts(self, tokenizer: Version) -> DataFrame:
        """One row per content: runs at the same time may have appended the same."""
        rows = self.spark.read.schema(SCHEMA).parquet(self.path).where(F.col("tokenizer") == tokenizer.digest)
        return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))

    def append(self, counts: DataFrame, tokenizer: Version) -> None:
        rows = counts.select("content", "n_tokens", F.lit(tokenizer.digest).alias("tokenizer"))
        rows.write.mode("append").partitionBy("tokenizer").parquet(self.path)


@functools.lru_cache(maxsize=2)
def _library(path: str):
    """Texts -> numbers of tokens, by the file's own library; one for each worker.

    Where white space separates tokens, words that come again keep their ids; they are encoded by the library's model.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    if version(path).folds:
        words = library_encoder(path)
        return lambda texts: [len(words.encode(t)) // words.width for t in texts]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_padding()
    model.no_truncation()
    return lambda texts: [len(e) for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def _pieces(text: str, folds: bool) -> Iterator[str]:
    """A long text in pieces that end at spaces, where no token of a folding tokenizer reaches across."""
    at = 0
    while folds and len(text) - at > BATCH_CHARS:
        end = text.rfind(" ", at, at + BATCH_CHARS)
        end = end if end > at else text.find(" ", at + BATCH_CHARS)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def encoded(texts: DataFrame, tokenizer: Version) -> DataFrame:
    """content and n_tokens of rows (content, text); texts are encoded in batches of about BATCH_CHARS."""
    tune(texts.sparkSession)
    path, folds = tokenizer.path, tokenizer.folds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _library(path)
        for batch in batches:
            totals = [0] * batch.num_rows
            rows: list[int] = []
            waiting: list[str] = []
            size = 0
            for k in range(batch.num_rows):
                for piece in _pieces(batch.column(1)[k].as_py(), folds):
                    rows.append(k)
                    waiting.append(piece)
                    size += len(piece)
                    if size >= BATCH_CHARS:
                        for r, n in zip(rows, count(waiting)):
                            totals[r] += n
                        rows, waiting, size = [], [], 0
            for r, n in zip(rows, count(waiting) if waiting else ()):
                totals[r] += n
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), pa.array(totals, pa.int64())], names=["content", "n_tokens"])

    return texts.select("content", "text").mapInArrow(run, "content binary, n_tokens long")


def token_counts(docs: DataFrame, path: str, cache: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit for every row, with the cache in the folder ``cache`` (a fresh one if None).

    Counts are those of the file's library for the whole text: tokenizers for .json, sentencepiece for .model, without
    added special tokens, truncation or padding. A null text is empty and has no tokens. Each row stands for itself: repeated
    rows give repeated rows, and a null doc_id stays null. Long texts are counted in pieces where the tokenizer allows it.
    Frequent contents, of which there are fewer than FREQUENT, get their counts by a broadcast, the others by a shuffle, so a
    content that a third of the rows has meets no single task. An empty table gives an empty result; columns other than
    doc_id and text are ignored, whatever their names.
    """
    spark = docs.sparkSession
    tokenizer = version(path)
    store = Cache(spark, cache or shared_dir(spark, "token-counts"))
    text = normalised(F.col("text"), tokenizer)
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    texts = docs.select(F.coalesce(doc_id, F.lit(0)).alias("row"), text.alias("text")).withColumn("content", F.unhex(F.sha2("text", 256)))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    rows = written(docs.select(doc_id, n_bytes, F.unhex(F.sha2(text, 256)).alias("content")), "contents")
    contents = written(rows.groupBy("content").agg(F.count("*").alias("n_rows"), F.min(F.coalesce("doc_id", F.lit(0))).alias("row")), "distinct-contents")

    misses = written(contents.join(store.counts(tokenizer), "content", "left_anti").select("content", "row"), "missing-contents")
    n_misses = misses.count()
    if n_misses:
        # one row stands for each content; rows that repeat its doc_id are combined before they are dealt
        few = n_misses <= FEW_MISSES
        wanted = texts.join(F.broadcast(misses), ["content", "row"], "left_semi") if few else texts
        single = wanted.groupBy("content", "row").agg(F.first("text").alias("text"))
        store.append(encoded(single if few else single.join(misses.hint("merge"), ["content", "row"], "left_semi"), tokenizer), tokenizer)

    total = rows.count()
    counts = contents.select("content", "n_rows").join(store.counts(tokenizer), "content")
    counts = written(counts.withColumn("frequent", F.col("n_rows") * FREQUENT > total), "content-counts")
    frequent, others = counts.where("frequent").select("content", "n_tokens"), counts.where("not frequent").select("content", "n_tokens")
    found = rows.join(F.broadcast(frequent), "content").unionByName(rows.join(F.broadcast(frequent), "content", "left_anti").join(others, "content"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
