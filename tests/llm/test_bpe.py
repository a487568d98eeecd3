import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("confluo.llm.bpe")
tokenizers = pytest.importorskip("tokenizers")
from confluo.llm import bpe
from confluo.llm.queries import tokenizer_path

PATH = tokenizer_path()
TEXTS = [
    "", " ", "Hello  World's it's 'S <|endoftext|> 123abc!!\n\n ñ 　x\x1cy", "ábc ẛ̣ ﬁ ΣΣ ΑΣ İ",
    "x" * 9000, "abé" * 5000, "!?" * 7000, "<|endoftext|>" * 50, "a<|startoftext|>'s<|endoftext", "'ll 'LL 've!'s 1's", "\u0000﻿​", "\U0001f600\U0001f1eb\U0001f1f7 café naïve",
    "é" * 4000, "각" * 2000, "the" * 3000 + " " + "12" * 2000,
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def ours(text):
    codec = bpe.Codec(PATH)
    return np.frombuffer(b"".join(r for r, _ in codec.spans(text)), "<u4").tolist()


@pytest.mark.parametrize("text", TEXTS)
def test_same_as_library(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert ours(text) == ids
    decoded = library.decode(ids, skip_special_tokens=False)
    assert bpe.Codec(PATH).digest(text) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_random_words_same_as_library(library):
    rng = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyz'0!éß \n"
    for _ in range(300):
        text = "".join(rng.choices(alphabet, k=rng.randint(1, 300)))
        assert ours(text) == library.encode(text, add_special_tokens=False).ids


def test_stream_is_independent_of_cuts(library):
    rng = random.Random(7)
    for text in TEXTS:
        want = library.encode(text, add_special_tokens=False).ids
        stream, got, at = bpe.StreamingEncoder(bpe.vocabulary(PATH)), [], 0
        while at < len(text):
            k = rng.randint(1, 700)
            got += stream.feed(text[at : at + k])
            at += k
        assert got + stream.finish() == want


def test_window_is_constant():
    vocab = bpe.vocabulary(PATH)
    word = bpe.WordTransducer(vocab)
    rng = random.Random(3)
    for _ in range(300):
        word.push("".join(rng.choices("etaoinshr", k=100)).encode())
        assert len(word.buffer) <= 2 * word.window
    assert 0 < vocab.lookahead < 1000


def test_lookahead_is_sufficient():
    """Whatever follows, tokens that end a lookahead before the cut stay the same."""
    rng = random.Random(11)
    for _ in range(200):
        letters = "abc"
        merges, known = [], list(letters)
        for _ in range(12):
            a, b = rng.choice(known), rng.choice(known)
            if (a, b) not in merges and len(a + b) < 7:
                merges.append((a, b))
                if a + b not in known:
                    known.append(a + b)
        ids = {t: i for i, t in enumerate(known)}
        names = {i: t for t, i in ids.items()}
        ranks = bpe.Ranks((ids[a], ids[b], ids[a + b]) for a, b in merges)
        look = bpe.sufficient_lookahead(merges, {t: len(t) for t in known})

        def bounds(text):
            at, out = 0, set()
            for t in bpe.merge([ids[c] for c in text], ranks):
                at += len(names[t])
                out.add(at)
            return out

        text = "".join(rng.choices(letters, k=60))
        for cut in range(10, 60, 7):
            a, b = bounds(text[:cut]), bounds(text)
            assert {x for x in a if x <= cut - look} == {x for x in b if x <= cut - look}


def test_table_cases(spark):
    rows = [(1, "Hello", "x"), (1, "Hello", "x"), (2, None, None), (None, "", "y")]
    got = sorted(map(tuple, bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids_sha256 string"), PATH).collect()), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 4 and (2, 0, empty, empty) in got and (None, 0, empty, empty) in got
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_every_code_point_same_as_library(library):
    """Between letters, and alone behind white space."""
    codec = bpe.Codec(PATH)
    texts = [f"A{chr(c)}b {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(texts), 40_000):
        some = texts[at : at + 40_000]
        want = [e.ids for e in library.encode_batch_fast(some, add_special_tokens=False)]
        bad = [t for t, ids in zip(some, want) if np.frombuffer(b"".join(r for r, _ in codec.spans(t)), "<u4").tolist() != ids]
        assert not bad, [hex(ord(t[1])) for t in bad[:20]]


def test_memory_stays_constant_over_a_long_text():
    """50 MB, fed and decoded in pieces: spaced text, an endless word, and both in turn."""
    import tracemalloc

    vocab = bpe.vocabulary(PATH)
    spaced, endless = "some words of a long text, and more; " * 1700, "abcdefghij" * 400
    stream, decoder = bpe.StreamingEncoder(vocab), bpe.StreamingDecoder(vocab)
    n = fed = 0
    for ids in (stream.feed(spaced), stream.feed(endless)):  # fills the caches
        decoder.feed(ids)
    tracemalloc.start()
    for k in range(800):
        piece = spaced if k % 40 else endless
        ids = stream.feed(piece)
        fed += len(piece)
        n += len(ids)
        decoder.feed(ids)
    n += len(stream.finish())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert fed > 45_000_000 and n > fed / 10 and peak < 16 << 20


def test_run_of_combining_marks(library):
    """Nothing can be cut there: the run waits, without being looked at again and again."""
    text = "a" + "\u0301\u0323" * 30_000 + " b"
    stream = bpe.StreamingEncoder(bpe.vocabulary(PATH))
    got = [i for at in range(0, len(text), 1000) for i in stream.feed(text[at : at + 1000])] + stream.finish()
    assert got == library.encode(text, add_special_tokens=False).ids


def test_decoder_over_cuts(library):
    """The emitted ids are decoded in pieces as the library decodes them at once."""
    rng = random.Random(2)
    vocab = bpe.vocabulary(PATH)
    for text in TEXTS:
        ids = library.encode(text, add_special_tokens=False).ids
        decoder, got, at = bpe.StreamingDecoder(vocab), "", 0
        while at < len(ids):
            k = rng.randint(1, 9)
            got += decoder.feed(ids[at : at + k])
            at += k
        assert got + decoder.finish() == library.decode(ids, skip_special_tokens=False)


def test_letters_with_marks_same_as_library(library):
    """Capitals that only compose with a mark in lower case: composition comes first."""
    import random
    import unicodedata

    from confluo.llm import tokenfile

    files = tokenfile.LibraryEncoder(PATH)
    marks = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.combining(chr(c))]
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123)]]
    pick = random.Random(11)
    pool = letters + marks[:200] + list(" \n.,'<|>é漢ÀİΣßÅ1")
    texts = [" ".join(f"a{x}{m}b {x}{m}" for x in letters) for m in marks] + ["".join(pick.choices(pool, k=pick.randrange(1, 30))) for _ in range(4000)]
    for text, want in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False)):
        assert ours(text) == want.ids, ascii(text)
        assert np.frombuffer(files.encode(text), f"<u{files.width}").tolist() == want.ids, ascii(text)
