import zlib

import numpy as np
import pytest

tokenfile = pytest.importorskip("confluo.llm.tokenfile")
from tokenizers import Tokenizer

from confluo.llm.queries import tokenizer_path

PATH = tokenizer_path()


def brute(rows):
    library, out, start = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip_is_exact(spark):
    rows = [(k, ["", None, "Hello <|endoftext|> wörld's 12", "x" * 3000, "same text"][k % 5]) for k in range(100)]
    df = spark.createDataFrame([(k, t, t) for k, t in rows][::-1], "doc_id long, text string, frame string").repartition(3)
    got = sorted(map(tuple, tokenfile.written_and_read(df, PATH).collect()))
    assert got == brute(rows)


def test_null_ids_ties_and_empty_table(spark):
    rows = [(None, "b"), (3, "a"), (3, "a"), (5, None)]
    got = sorted(map(tuple, tokenfile.written_and_read(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()), key=lambda r: r[1])
    assert got == brute(rows)
    assert tokenfile.written_and_read(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_one_document_by_index(spark, tmp_path):
    df = spark.createDataFrame([(k, f"word{k} and more words") for k in range(50)], "doc_id long, text string")
    manifest = tokenfile.write(df, PATH, str(tmp_path / "t"))
    library = Tokenizer.from_file(PATH)
    for r in manifest:
        file = tokenfile.TokenFile(r["path"])
        k = len(file) // 2
        assert file.ids(k).tolist() == library.encode(f"word{file.index['doc_id'][k]} and more words", add_special_tokens=False).ids
        file.close()


def test_words_same_as_library():
    import random

    library, ours, rng = Tokenizer.from_file(PATH), tokenfile.LibraryEncoder(PATH), random.Random(3)
    alphabet = "abcXYZéÉßñÜ'.,;!?|<>09µªİΣe\u0301\u00a0\u3000"
    for _ in range(3000):
        text = " ".join("".join(rng.choices(alphabet, k=rng.randint(1, 9))) for _ in range(rng.randint(1, 4)))
        assert np.frombuffer(ours.encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_many_rows_without_id(spark):
    rows = [(None, f"word{k % 7} and more") for k in range(60)] + [(k, "x") for k in range(5)]
    got = sorted(map(tuple, tokenfile.written_and_read(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), PATH).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None] * 60 + list(range(5))
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in brute(rows))


def test_dictionary_is_drawn_from_the_whole_table(spark, monkeypatch):
    """The texts of smallest hash train it, wherever they stand."""
    monkeypatch.setattr(tokenfile, "DICTIONARY_TEXTS", 40)
    df = spark.createDataFrame([(k, f"some words of text {k} that come again and again {k % 9} " * 20) for k in range(400)], "doc_id long, text string")
    a, b = tokenfile.train_dictionary(df.orderBy("doc_id").repartition(7), PATH), tokenfile.train_dictionary(df.orderBy("doc_id", ascending=False).repartition(2), PATH)
    assert a and a == b
