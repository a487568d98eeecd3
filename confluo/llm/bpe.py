"""BPE encoding as a streaming transducer with bounded lookahead, and decoding as an incremental state machine.

The merge list alone bounds how far the text to the right of a position can change the tokens to its left.
``sufficient_lookahead`` computes that bound, so an encoder keeps a window of constant size and emits tokens once no
continuation can change them. White space ends a word and makes all its tokens stable; within a longer word tokens leave
piece by piece. Texts are fed in pieces, the ids that come out are fed to the decoder at once, and neither keeps more than
its window. What the transducer gives for a short word is kept in a bounded cache; that only saves time.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import tidied, tune

#: Words up to so many characters go through the caches.
CACHED_CHARS = 64
#: Characters of a text that are fed at once.
PIECE = 1 << 16
#: Entries of the caches before they start anew.
WORDS, PIECES = 200_000, 150_000
#: Marks that are tokens of their own behind an ASCII letter, under the pattern of words, digits and other characters.
CLOSING = frozenset(bytes([c]) for c in b".,;:!?|")


@functools.lru_cache(maxsize=1)
def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    chars, extra = [""] * 256, 0x100
    for b in range(256):
        if b in shown:
            chars[b] = chr(b)
        else:
            chars[b] = chr(extra)
            extra += 1
    return chars


def sufficient_lookahead(merges: list[tuple[str, str]], length: dict[str, int]) -> int:
    """Symbols after a boundary that can decide whether BPE merges across it.

    A merge (u, v) across a boundary depends on v standing there unmerged to its right when its turn comes. That can only
    change through an earlier merge (s, x) at the right end of v, where s is on the right spine of v's derivation. So the
    reach of (u, v) is len(v) plus the longest reach of such an earlier merge, computed here in order of priority.
    """
    spine: dict[str, list[str]] = {}
    best: dict[str, int] = {}
    reach = 0
    for u, v in merges:
        own = spine.get(v, [v])
        mine = length[v] + max((best.get(s, 0) for s in own), default=0)
        reach = max(reach, mine)
        best[u] = max(best.get(u, 0), mine)
        made = u + v
        if made not in spine:
            spine[made] = [made, *own]
    return reach


@functools.lru_cache(maxsize=1)
def characters() -> dict:
    """What the tokenizers library takes for letters, numbers and white space, and where its tables of case and composition
    differ from Python's; its Unicode version is its own.

    Classes are strings of ranges for a pattern. About a second's work, done once and sent to the workers.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]

    def ranges(pattern: str) -> str:
        found = pre_tokenizers.Split(Regex(pattern + "+"), "removed", invert=True).pre_tokenize_str("".join(every))
        return "".join(f"{regex.escape(run[0], special_only=False)}-{regex.escape(run[-1], special_only=False)}" for piece, _ in found for run in _runs(piece))

    def differing(normalizer, own) -> dict[int, str]:
        plain = [c for c in every if c != "\n"]
        return {ord(c): got for c, got in zip(plain, normalizer.normalize_str("\n".join(plain)).split("\n")) if got != own(c)}

    return {
        r"\p{L}": ranges(r"\p{L}"), r"\p{N}": ranges(r"\p{N}"), r"\s": ranges(r"\s"), "lower": differing(normalizers.Lowercase(), str.lower),
        "nfc": differing(normalizers.NFC(), lambda c: unicodedata.normalize("NFC", c)),
    }


def _runs(piece: str) -> Iterator[str]:
    """Stretches of consecutive code points."""
    codes = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
    cuts = np.flatnonzero(np.diff(codes) != 1) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(piece)]):
        yield piece[a:b]


def has_marks(raw: bytes) -> bool:
    """Whether UTF-8 holds a character from U+0300 to U+037F, as all marks are that compose with ASCII letters."""
    return b"\xcc" in raw or b"\xcd" in raw


class Vocabulary:
    """The parts of a tokenizer file that encoding needs: ids, ranked merges, marks and special tokens.

    It also holds the caches of what the transducer gave for short words.
    """

    def __init__(self, path: str, classes: dict | None = None):
        self.classes = classes or characters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain BPE vocabularies are supported")
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.ranks = Ranks((self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs)
        alphabet = byte_alphabet()
        self.symbol = [self.ids[c] for c in alphabet]
        self.last_symbol = [self.ids[c + self.suffix] for c in alphabet]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        length = {t: len(t.removesuffix(self.suffix)) if self.suffix else len(t) for t in self.ids}
        self.lookahead = sufficient_lookahead(pairs, length)
        normal = spec.get("normalizer") or {}
        steps = [n["type"] for n in normal.get("normalizers", [normal] if normal else [])]
        self.nfc, self.lower = "NFC" in steps, "Lowercase" in steps
        split = next(p for p in spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]]) if p["type"] == "Split")
        if not split["invert"] or split["behavior"] != "Removed":
            raise ValueError("the splitter must keep what its pattern matches")
        self.pattern = regex.compile(self.with_classes(split["pattern"]["Regex"]))
        self.letter, self.letters, self.others = (regex.compile(self.with_classes(x)) for x in (r"[\p{L}]", r"[\p{L}]+", r"[^\s\p{L}\p{N}]+"))
        marks = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.marks = regex.compile("|".join(marks)) if marks else None
        decoder = spec.get("decoder") or {}
        self.byte_decoder = decoder.get("type") == "ByteLevel"
        if decoder and not self.byte_decoder:
            raise ValueError("only byte-level decoders, or none, are supported")
        self.pieces = _Cache(self._piece, PIECES)
        self.words = _Cache(self._word, WORDS)
        # runs of letters, and marks behind them, are matches of their own; words come in lower case if it matters
        matches = self.pattern.findall
        self.simple = self.lower and all(matches(f"ab{c.decode()}") == ["ab", c.decode()] for c in CLOSING)

    def forget(self) -> None:
        """Empty the caches, so that a worker that goes on to other work does not keep them."""
        for cache in (self.words, self.pieces):
            cache.clear()
            cache.old = {}

    def with_classes(self, pattern: str) -> str:
        """The pattern with its classes written out; a class outside brackets gets brackets."""
        out, inside, at = [], False, 0
        while at < len(pattern):
            name = next((n for n in (r"\p{L}", r"\p{N}", r"\s") if pattern.startswith(n, at)), None)
            if name:
                out.append(self.classes[name] if inside else f"[{self.classes[name]}]")
                at += len(name)
                continue
            size = 2 if pattern[at] == "\\" else 1
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out.append(pattern[at : at + size])
            at += size
        return "".join(out)

    def normal(self, text: str) -> str:
        """NFC and lower case character by character, without rules that look at the neighbours, where the file asks for them."""
        if self.nfc and not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if self.classes["nfc"]:
                text = text.translate(self.classes["nfc"])
        if not self.lower:
            return text
        if text.isascii():
            return text.lower()
        special = self.classes["lower"]
        if "\u03a3" in text or any(ord(c) in special for c in text):
            return "".join(special.get(ord(c)) or c.lower() for c in text)
        return text.lower()

    def _piece(self, piece: str) -> bytes:
        """The ids of one match, through the transducer."""
        word = WordTransducer(self)
        return packed(word.push(piece.encode()) + word.finish())

    def _word(self, word: bytes) -> bytes:
        """The ids of what stands between ASCII white space: its matches, each stable as it ends."""
        if self.simple and len(word) <= CACHED_CHARS and word.islower():
            if word.isalpha():
                return self.pieces[word.decode()]
            if word[-1:] in CLOSING and word[:-1].isalpha():
                return self.pieces[word[:-1].decode()] + self.pieces[word[-1:].decode()]
        text = word.decode()
        if len(text) > CACHED_CHARS or (self.marks and "<" in text):
            stream = StreamingEncoder(self)
            return stream.slowly(text) + stream.slowly("", True)
        return b"".join([self.pieces[p] for p in self.pattern.findall(self.normal(text))])


@functools.lru_cache(maxsize=4)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path, _sent.get("classes"))


#: The classes that came with a task, so that a worker need not ask the library.
_sent: dict[str, dict] = {}


def vocabulary(path: str, classes: dict | None = None) -> Vocabulary:
    """One for each process and file."""
    if classes:
        _sent.setdefault("classes", classes)
    return _vocabulary(path)


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class Ranks(dict):
    """(left id, right id) as one integer -> (rank, merged id) as one integer, which sorts by rank."""

    BITS = 24
    NONE = 1 << 62

    def __init__(self, merges: Iterable[tuple[int, int, int]]):
        super().__init__()
        for rank, (a, b, made) in enumerate(merges):
            self.setdefault(a << self.BITS | b, rank << self.BITS | made)


def merge(symbols: list[int], ranks: Ranks) -> list[int]:
    """Apply the merges by rank, the leftmost first."""
    if len(symbols) > 64:
        return _merge_heap(symbols, ranks)
    get, bits, none = ranks.get, Ranks.BITS, Ranks.NONE
    found = [get(a << bits | b, none) for a, b in zip(symbols, symbols[1:])]
    while found:
        best = min(found)
        if best == none:
            break
        at = found.index(best)
        made = symbols[at] = best & (1 << bits) - 1
        del symbols[at + 1], found[at]
        if at:
            found[at - 1] = get(symbols[at - 1] << bits | made, none)
        if at < len(found):
            found[at] = get(made << bits | symbols[at + 1], none)
    return symbols


def _merge_heap(symbols: list[int], ranks: Ranks) -> list[int]:
    n, bits = len(symbols), Ranks.BITS
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = right[i]
        if j < n and (found := ranks.get(symbols[i] << bits | symbols[j])) is not None:
            heapq.heappush(heap, (found, i, symbols[i], symbols[j]))

    for i in range(n - 1):
        push(i)
    while heap:
        found, i, a, b = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or symbols[i] != a or j >= n or symbols[j] != b:
            continue
        symbols[i], alive[j] = found & (1 << bits) - 1, False
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        push(i)
        if left[i] >= 0:
            push(left[i])
    return [s for s, kept in zip(symbols, alive) if kept]


class WordTransducer:
    """BPE over the symbols of one word that may be endless: tokens leave once no continuation can change them."""

    def __init__(self, vocab: Vocabulary, window: int | None = None):
        self.vocab = vocab
        self.keep = vocab.lookahead + 1  # the last symbol may still become the marked one that ends the word
        self.window = max(window or 0, 4 * self.keep)
        self.buffer = bytearray()

    def push(self, raw: bytes) -> list[int]:
        out: list[int] = []
        for at in range(0, len(raw), self.window):
            self.buffer += raw[at : at + self.window]
            if len(self.buffer) > self.window:
                out += self._emit()
        return out

    def _emit(self) -> list[int]:
        vocab, stable = self.vocab, len(self.buffer) - self.keep
        symbol = vocab.symbol
        tokens = merge([symbol[b] for b in self.buffer[:-1]], vocab.ranks)
        out, at = [], 0
        for t in tokens:
            size = len(vocab.token_of[t])
            if at + size > stable:
                break
            out.append(t)
            at += size
        del self.buffer[:at]
        return out

    def finish(self) -> list[int]:
        if not self.buffer:
            return []
        symbols = [self.vocab.symbol[b] for b in self.buffer]
        symbols[-1] = self.vocab.last_symbol[self.buffer[-1]]
        self.buffer.clear()
        return merge(symbols, self.vocab.ranks)


@functools.lru_cache(maxsize=1)
def _joins_left() -> frozenset[str]:
    """Characters that normalisation may join to the one before them."""
    found = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.combining(ch):
            found.add(ch)
        parts = unicodedata.decomposition(ch)
        if parts and parts[0] != "<":
            found.update(chr(int(x, 16)) for x in parts.split()[1:])
    return frozenset(found)


class StreamingEncoder:
    """Text in pieces of any size in, ids out as soon as they are stable; memory does not grow with the text.

    ``feed`` returns the ids that are certain so far, ``finish`` the rest. The ids are those of encoding the whole text at
    once, however it was cut. Only a run of combining marks has to be held whole, since composition sorts it.
    """

    #: Characters that may wait before a cut inside a word is looked for.
    PENDING = 4096

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.waiting: list[str] = []  # raw text without a place to cut at
        self.size, self.limit = 0, self.PENDING
        self.open = ""  # normalised text in which a match may still grow or start
        self.word: WordTransducer | None = None  # an endless match
        self.same: regex.Pattern | None = None
        self.longest = max(map(len, vocab.special), default=0)

    def feed(self, text: str) -> list[int]:
        return np.frombuffer(self.push(text), "<u4").tolist()

    def finish(self) -> list[int]:
        return np.frombuffer(self.end(), "<u4").tolist()

    def push(self, text: str) -> bytes:
        """As ``feed``, with the ids as little-endian unsigned 32-bit integers."""
        out = []
        for at in range(0, len(text), PIECE):
            piece = text[at : at + PIECE]
            space = max(piece.rfind(c) for c in " \n\t")
            if space >= 0:
                out.append(self._words("".join([*self.waiting, piece[: space + 1]])))
                self.waiting, piece, self.limit = [], piece[space + 1 :], self.PENDING
                self.size = 0
            if piece:
                self.waiting.append(piece)
                self.size += len(piece)
            if self.size >= self.limit:
                out.append(self._inside())
        return b"".join(out)

    def end(self) -> bytes:
        rest, self.waiting, self.size = "".join(self.waiting), [], 0
        return self._words(rest) if self.word is None and not self.open else self.slowly(rest, True)

    def _words(self, text: str) -> bytes:
        """The ids of text that ends with white space, or with the whole text."""
        out = []
        if self.word is not None or self.open:  # the end of a word that is emitted piece by piece
            space = min((k for k in map(text.find, " \n\t") if k >= 0), default=len(text))
            out.append(self.slowly(text[:space], True))
            text = text[space:]
        raw = text.encode()
        folds = self.vocab.lower and not (self.vocab.marks and b"<" in raw)  # the case of special tokens counts
        if folds and not has_marks(raw):
            words = raw.lower().split()
        else:  # a mark behind a capital may compose with its small letter only; composition comes before lower case
            words = [w.lower() if folds and w.isascii() else w for w in raw.split()]
        out += map(self.vocab.words.__getitem__, words)
        return b"".join(out)

    def _inside(self) -> bytes:
        """The ids up to a cut inside a word, where nothing joins; if there is none, the next try waits for twice the text."""
        text, joins = "".join(self.waiting), _joins_left()
        for at in range(len(text) - max(1, self.longest), 0, -1):
            inside = self.longest and any(m.start() + max(0, at - self.longest) < at < m.end() + max(0, at - self.longest) for m in self.vocab.marks.finditer(text[max(0, at - self.longest) : at + self.longest]))
            if text[at] not in joins and not inside:
                self.waiting, self.size, self.limit = [text[at:]], len(text) - at, self.PENDING + len(text) - at
                return self.slowly(text[:at])
        self.waiting, self.limit = [text], 2 * len(text)
        return b""

    def slowly(self, raw: str, final: bool = False) -> bytes:
        """Raw text whose ends nothing joins, match by match; ``final`` says that no match goes on behind it."""
        out, at = [], 0
        for m in self.vocab.marks.finditer(raw) if self.vocab.marks else ():
            out += self._match(self.vocab.normal(raw[at : m.start()]), True)
            out.append(self.vocab.special[m[0]])
            at = m.end()
        return packed(out + self._match(self.vocab.normal(raw[at:]), final))

    def _match(self, text: str, final: bool) -> list[int]:
        out: list[int] = []
        if self.word is not None:
            m = self.same.match(text)
            end = m.end() if m else 0
            out += self.word.push(text[:end].encode())
            if end == len(text) and not final:
                return out
            out += self.word.finish()
            self.word, text = None, text[end:]
        text, self.open = self.open + text, ""
        for m in self.vocab.pattern.finditer(text):
            if m.end() > len(text) - 4 and not final:  # it may grow, or be another alternative
                self.open = text[m.start() :]
                if len(self.open) > CACHED_CHARS:
                    self._start()
                    out += self.word.push(self.open.encode())
                    self.open = ""
                return out
            out += np.frombuffer(self.vocab.pieces[m[0]], "<u4").tolist()
        return out

    def _start(self) -> None:
        """A match that is this long is a run of letters, or of neither letters, digits nor white space."""
        self.word = WordTransducer(self.vocab)
        self.same = self.vocab.letters if self.vocab.letter.match(self.open) else self.vocab.others


class StreamingDecoder:
    """Ids in, text out, piece by piece.

    Without a decoder in the tokenizer file the tokens are joined by single spaces. With a byte-level one, tokens become
    bytes, and bytes become text as soon as a character is complete.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.first = True
        self.bytes = codecs.getincrementaldecoder("utf-8")("replace")
        self.value = {c: b for b, c in enumerate(byte_alphabet())} if vocab.byte_decoder else {}

    def feed(self, ids: Iterable[int]) -> str:
        token = self.vocab.token_of
        if self.vocab.byte_decoder:
            return self.bytes.decode(b"".join(bytes(self.value[c] for c in token[i]) for i in ids))
        text = " ".join(map(token.__getitem__, ids))
        if not text:
            return ""
        text, self.first = (text if self.first else " " + text), False
        return text

    def finish(self) -> str:
        return self.bytes.decode(b"", True) if self.vocab.byte_decoder else ""


class _Cache(dict):
    """What ``make`` gives for a key. A full cache becomes the old one, from which keys that come again return."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
            if len(key) > CACHED_CHARS:
                return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Runs texts through the encoder, and what it emits through the decoder, piece by piece."""

    def __init__(self, path: str, classes: dict | None = None):
        self.vocab = vocabulary(path, classes)

    def spans(self, text: str) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text in UTF-8), as they become certain."""
        encoder, decoder = StreamingEncoder(self.vocab), StreamingDecoder(self.vocab)
        for at in range(0, len(text), PIECE):
            raw = encoder.push(text[at : at + PIECE])
            yield raw, decoder.feed(np.frombuffer(raw, "<u4").tolist()).encode()
        raw = encoder.end()
        yield raw, (decoder.feed(np.frombuffer(raw, "<u4").tolist()) + decoder.finish()).encode()

    def digest(self, text: str) -> tuple[int, str, str]:
        ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
        for raw, shown in self.spans(text):
            ids.update(raw)
            decoded.update(shown)
            n += len(raw) // 4
        return n, ids.hexdigest(), decoded.hexdigest()


ROUND_TRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode every text and decode it again: doc_id, n_tokens and the digests of ids and of the decoded text.

    A null or empty text has no tokens and decodes to the empty text. Each row stands for itself, so repeated rows give
    repeated rows, a null doc_id stays null and an empty table gives an empty result. Other columns are ignored.
    """
    tune(docs.sparkSession)
    classes = characters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, classes)
        for batch in batches:
            rows = [codec.digest(t or "") for t in batch.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        codec.vocab.forget()

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(tidied(run), ROUND_TRIP)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and the ids of every text as an array of integers; null and empty texts have empty arrays.

    Each row stands for itself; a null doc_id stays null and other columns are ignored.
    """
    tune(docs.sparkSession)
    classes = characters()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, classes)
        for batch in batches:
            rows = [np.frombuffer(b"".join(raw for raw, _ in codec.spans(t or "")), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["doc_id", "ids"])
        codec.vocab.forget()

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(tidied(run), "doc_id long, ids array<int>")
