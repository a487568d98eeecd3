import random
import shutil

import pytest

counts = pytest.importorskip("confluo.llm.token_counts")
from tokenizers import Tokenizer

from confluo.llm.queries import tokenizer_path

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"]


def library(name):
    path = tokenizer_path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(model.encode(t))
    model = Tokenizer.from_file(path)
    return lambda t: len(model.encode(t, add_special_tokens=False).ids)


def rows():
    pick = random.Random(9)
    pool = ["Hello", "hello", " ", "  ", "\n", "\t", "\r\n", "\v\f", " ", "\x1c", "H̱", "́", "É", "İ", "ΑΣ", "漢", "😀", "12", "'S", "<|ENDOFTEXT|>", "<|endoftext|>", "<", "|>", "!!"]
    texts = [None, "", " \n ", "Same  text.", "same text.", "SAME\ntext. "] + ["".join(pick.choices(pool, k=pick.randrange(1, 12))) for _ in range(300)]
    texts.append("long Words, " * 120_000 + "x" * 10)
    return [(None if k % 40 == 7 else k // 2, t) for k, t in enumerate(texts)] * 2 + [(10_000 + k, "Hot text") for k in range(200)] + [(5, "Hot text")] * 50


def frame(spark, found):
    return spark.createDataFrame([(k, t, "c", 1) for k, t in found], "doc_id long, text string, content string, n_tokens long").repartition(4)


def brute(found, count, limit):
    key = lambda r: tuple((v is None, v) for v in r)
    known = {t: count(t or "") for t in {t for _, t in found}}
    return sorted(((k, len((t or "").encode()), known[t], known[t] > limit) for k, t in found), key=key)


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: tuple((v is None, v) for v in r))


@pytest.mark.parametrize("name", FILES)
def test_same_as_library(spark, name):
    found = rows()
    got = sorted_rows(counts.token_counts(frame(spark, found), tokenizer_path(name), limit=10))
    assert got == brute(found, library(name), 10)


@pytest.mark.parametrize("few", [0, 50_000])
def test_only_missing_contents_are_encoded(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(counts, "FEW_MISSES", few)
    sent = []
    whole = counts.encoded
    monkeypatch.setattr(counts, "encoded", lambda texts, v: (sent.append(sorted(r.text for r in texts.collect())), whole(texts, v))[1])
    path, cache = tokenizer_path(), str(tmp_path / "cache")
    first = [(1, "One  text"), (2, "one text"), (3, "ÉTÉ ẖ"), (3, "ÉTÉ ẖ"), (None, "null id"), (None, "null id")]
    assert sorted_rows(counts.token_counts(frame(spark, first), path, cache)) == brute(first, library(FILES[0]), counts.LIMIT)
    assert sent == [["null id", "one text", "ÉTÉ ẖ"]]
    more = first + [(9, "Something new"), (10, None)]
    assert sorted_rows(counts.token_counts(frame(spark, more), path, cache)) == brute(more, library(FILES[0]), counts.LIMIT)
    assert sent[1:] == [["", "something new"]]
    counts.token_counts(frame(spark, more), path, cache)
    assert len(sent) == 2
    other = str(tmp_path / "word_bpe.json")
    shutil.copy(path, other)
    with open(other, "a") as f:
        f.write("\n")  # another version of the same vocabulary
    counts.token_counts(frame(spark, first), other, cache)
    assert len(sent) == 3 and len(sent[2]) == 3


def test_runs_that_append_the_same(spark, tmp_path):
    path, cache = tokenizer_path(), str(tmp_path / "cache")
    found = [(1, "a b c"), (2, "d")]
    counts.token_counts(frame(spark, found), path, cache)
    v, store = counts.version(path), counts.Cache(spark, cache)
    store.append(store.counts(v), v)
    assert sorted_rows(counts.token_counts(frame(spark, found), path, cache)) == brute(found, library(FILES[0]), counts.LIMIT)


def test_empty_table(spark):
    assert counts.token_counts(frame(spark, []), tokenizer_path()).count() == 0


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(counts, "BATCH_CHARS", 7)
    for text in ("", "abc", "a b c d e f g h", "abcdefghijkl m", "abcdefghijklmnop", "ab cdefghijklmnopq rs"):
        pieces = list(counts._pieces(text, True))
        assert "".join(pieces) == text and all(p.startswith(" ") for p in pieces[1:])
        assert list(counts._pieces(text, False)) == [text]
