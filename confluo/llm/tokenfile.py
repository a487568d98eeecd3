"""Token-id files: documents compressed one by one with a shared zstandard dictionary, and an index for short access.

File layout (all numbers little-endian)::

    magic 8 bytes | id width 1 byte | SHA-256 of the dictionary 32 bytes
    one zstandard frame per document, each an array of ids of that width
    index: INDEX rows (doc_id, has_id, offset, size, n_tokens)
    offset of the index u64 | number of documents u64 | magic 8 bytes

The dictionary lies beside the files as ``<sha256>.zdict``. One document is read with the footer, the index and one frame.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_alphabet, has_marks
from .common import ranges, shared_dir, split_points, tune

MAGIC = b"CFTOKEN1"
HEADER = struct.Struct("<8sB32s")
FOOTER = struct.Struct("<QQ8s")
INDEX = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("size", "<u8"), ("n_tokens", "<u8")])
#: The dictionary is trained on so many texts at most, those with the smallest hashes of doc_id, and on so many bytes from
#: the middle of each one's ids; it decides sizes only.
DICTIONARY_TEXTS = 600
SAMPLE_BYTES = 16 << 10
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
CACHED_BYTES = 64
CACHE_ENTRIES = 900_000
CLOSING = frozenset(bytes([c]) for c in b".,;:!?|")


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class LibraryEncoder:
    """Ids of a tokenizers-library file. White space separates tokens there, so words are encoded once and kept."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"].get("pretokenizers", [])
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        known = normal == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in steps] == ["Split", "ByteLevel"]
        self.by_word = known and any(p["type"] == "Split" and p["invert"] and p["behavior"] == "Removed" and r"\s" in p["pattern"].get("Regex", "") for p in steps)
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.letter = "H" if self.width == 2 else "I"
        self.words = _Words(self)
        alphabet = byte_alphabet()
        self.shown = {b: alphabet[b] for b in range(256)}

    def _pack(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.letter}", *ids)

    def word(self, word: bytes) -> bytes:
        """The ids of one word, in lower case (ASCII) unless it holds marks.

        A letter and one closing mark after it are separate tokens, so such a word is put together from both. A run of
        Latin letters is one piece: the library's model takes it with its bytes written as characters. Other words go
        through the whole library.
        """
        if word.isalpha():
            return self._bytes([t.id for t in self.library.model.tokenize(word.decode())])
        if word[-1:] in CLOSING and len(word) > 1:
            stem = word[:-1]
            last = "" if stem.isalpha() else stem.decode()[-1]
            if not last or (last.isalpha() and last.lower().isalpha()):
                return self.words[stem] + self.words[word[-1:]]
        text = word.decode()
        small = "".join(c.lower() for c in unicodedata.normalize("NFC", text)) if max(text) < "\u0250" else ""
        if small.isalpha():
            shown = small.encode().decode("latin-1").translate(self.shown)
            return self._bytes([t.id for t in self.library.model.tokenize(shown)])
        return self._pack([text])[0]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian integers of ``width`` bytes."""
        raw = text.encode()
        if not self.by_word or b"<" in raw:  # marks keep their case
            return self._pack([text])[0]
        # a mark behind a capital may compose with its small letter only; composition comes before lower case
        words = [w.lower() if w.isascii() else w for w in raw.split()] if has_marks(raw) else raw.lower().split()
        return b"".join(map(self.words.__getitem__, words))


class _Words(dict):
    """Ids of the words that came; starts anew when it is full."""

    def __init__(self, encoder: LibraryEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: bytes) -> bytes:
        ids = self.encoder.word(word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = ids
        return ids


@functools.lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    """One for each Python worker, which keeps its words from task to task."""
    return LibraryEncoder(path)


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A zstandard dictionary from the serialised ids of at most DICTIONARY_TEXTS texts; empty if they are too few.

    The texts are picked by hash from the whole table and encoded where they lie; one task gets SAMPLE_BYTES of each and
    trains, so that only the dictionary reaches the driver.
    """

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        for batch in batches:
            found = []
            for t in batch.column(0).to_pylist():
                ids = encoder.encode(t)
                at = max(0, (len(ids) - SAMPLE_BYTES) // 2) // encoder.width * encoder.width
                found.append(ids[at : at + SAMPLE_BYTES])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["ids"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = sorted(x for batch in batches for x in batch.column(0).to_pylist())
        try:
            found = zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            found = b""
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], names=["dictionary"])

    known = docs.where("doc_id is not null and text <> ''")
    chosen = known.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(DICTIONARY_TEXTS)
    texts = known.join(F.broadcast(chosen), "doc_id", "left_semi").select("text")  # at most DICTIONARY_TEXTS ids
    found = texts.mapInArrow(sample, "ids binary").repartition(1).mapInArrow(train, "dictionary binary").collect()
    return bytes(found[0][0]) if found else b""


class TokenFile:
    """Random access to one file: only the footer, the index and the wanted frames are read."""

    def __init__(self, path: str):
        self.fs, self.path = filesystem(path)
        self.file = self.fs.open_input_file(self.path)
        self.file.seek(self.file.size() - FOOTER.size)
        at, n, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.file.seek(0)
        _, self.width, digest = HEADER.unpack(self.file.read(HEADER.size))
        self.file.seek(at)
        self.index = np.frombuffer(self.file.read(n * INDEX.itemsize), INDEX)
        with self.fs.open_input_file(f"{os.path.dirname(self.path)}/{digest.hex()}.zdict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"the dictionary of {path} is another one")
        self.zstd = zstandard.ZstdDecompressor(zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def ids(self, k: int) -> np.ndarray:
        row = self.index[k]
        self.file.seek(int(row["offset"]))
        return np.frombuffer(self.zstd.decompress(self.file.read(int(row["size"]))), f"<u{self.width}")

    def __len__(self) -> int:
        return len(self.index)

    def close(self) -> None:
        self.file.close()


class TokenWriter:
    """One file, written front to back; the index follows the frames."""

    def __init__(self, folder: str, bucket: int, width: int, digest: bytes):
        self.bucket, self.path = bucket, f"{folder}/part-{bucket:06d}-{uuid.uuid4().hex}.tok"
        fs, where = filesystem(self.path)
        self.out = fs.open_output_stream(where)
        self.out.write(HEADER.pack(MAGIC, width, digest))
        self.at, self.rows = HEADER.size, []

    def add(self, doc_id: int | None, n_tokens: int, frame: bytes) -> None:
        self.rows.append((doc_id or 0, doc_id is not None, self.at, len(frame), n_tokens))
        self.out.write(frame)
        self.at += len(frame)

    def close(self) -> tuple[int, str, int, int, int]:
        """Bucket, path, documents, ids and bytes of the finished file."""
        index = np.array(self.rows, INDEX)
        self.out.write(index.tobytes() + FOOTER.pack(self.at, len(index), MAGIC))
        self.out.close()
        return self.bucket, self.path, len(index), int(index["n_tokens"].sum()), self.at


MANIFEST = "bucket int, path string, n_docs long, n_tokens long, n_bytes long"


def write(docs: DataFrame, path: str, folder: str, end_id: int | None = None) -> list[dict]:
    """Write all texts as token files into ``folder``, in ascending order of doc_id over all files; return the manifest.

    Ranges of doc_id are cut at approximate quantiles, as many as the size of the table asks for; each range is one file,
    written by its own task in order. Rows without doc_id come first, dealt to as many files by a hash; rows of equal doc_id,
    and those without, are ordered by their frames. A null text counts as empty. A repeated attempt of a task writes under
    another name, and only the files of the manifest count.
    """
    spark = docs.sparkSession
    tune(spark)
    dictionary = train_dictionary(docs, path)
    digest = hashlib.sha256(dictionary).digest()
    fs, top = filesystem(folder)
    fs.create_dir(top, recursive=True)
    with fs.open_output_stream(f"{top}/{digest.hex()}.zdict") as f:
        f.write(dictionary)
    n = ranges(docs)
    points = np.array(split_points(docs.select("doc_id"), "doc_id", n), np.int64)
    ahead = n if docs.where("doc_id is null").limit(1).count() else 0  # files for rows without doc_id

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        end = b"" if end_id is None else end_id.to_bytes(encoder.width, "little")
        for batch in batches:
            ids, frames, counts = batch.column(0), [], []
            for t in batch.column(1).to_pylist():
                raw = encoder.encode(t or "") + end
                frames.append(zstd.compress(raw))
                counts.append(len(raw) // encoder.width)
            bucket = np.searchsorted(points, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right") + ahead
            for k in np.flatnonzero(np.asarray(ids.is_null())).tolist():
                bucket[k] = zlib.crc32(frames[k]) % ahead
            cols = [pa.array(bucket.astype(np.int32)), ids, pa.array(counts, pa.int64()), pa.array(frames, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", "doc_id", "n_tokens", "frame"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, writer, made = library_encoder(path).width, None, []
        for batch in batches:
            for bucket, doc_id, n, frame in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if writer is None or bucket != writer.bucket:
                    if writer is not None:
                        made.append(writer.close())
                    writer = TokenWriter(folder, bucket, width, digest)
                writer.add(doc_id, n, frame)
        if writer is not None:
            made.append(writer.close())
        cols = list(zip(*made)) if made else [()] * 5
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["bucket", "path", "n_docs", "n_tokens", "n_bytes"])

    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(compress, "bucket int, doc_id long, n_tokens long, frame binary")
    dealt = rows.repartitionById(ahead + len(points) + 1, "bucket").sortWithinPartitions("bucket", "doc_id", "frame")
    found = sorted((r.asDict() for r in dealt.mapInArrow(store, MANIFEST).collect()), key=lambda r: r["bucket"])
    start = 0
    for r in found:
        r["start"] = start
        start += r["n_tokens"]
    return found


READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """Read the files back: doc_id, ids of all documents before it, its number of ids and the crc32 of its ids."""
    if not manifest:
        return spark.createDataFrame([], READ)
    files = spark.createDataFrame([(r["path"], r["start"]) for r in manifest], "path string, start long").repartition(len(manifest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(path)
                n = file.index["n_tokens"].astype(np.int64)
                starts = start + np.cumsum(n) - n
                for at in range(0, len(file), 4096):
                    some = slice(at, min(at + 4096, len(file)))
                    crc = []
                    for k in range(some.start, some.stop):
                        ids = file.ids(k)
                        if len(ids) != n[k]:
                            raise ValueError(f"{path}: document {k} has {len(ids)} ids instead of {n[k]}")
                        crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    doc_id = pa.array(file.index["doc_id"][some], pa.int64(), mask=file.index["has_id"][some] == 0)
                    yield pa.RecordBatch.from_arrays([doc_id, pa.array(starts[some]), pa.array(n[some]), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                file.close()

    return files.mapInArrow(run, READ)


def written_and_read(docs: DataFrame, path: str, end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Write the token files of ``docs`` and return what reading them back gives; an empty table gives no rows."""
    spark = docs.sparkSession
    return read(spark, write(docs, path, folder or shared_dir(spark, "tokens"), end_id))
