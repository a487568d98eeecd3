"""Fill-in-the-middle: prefix, suffix and middle of a text in another order, cut by big-integer bit-parallelism.

A text is its UTF-8 bytes. ``bytes.translate`` turns each class of bytes into digits, which make one integer with a bit for
each byte. Shifts and boolean operations on such integers mark where units start and where markers stand, ``bit_count``
counts units, and halving the integer again and again finds the bits of given ranks. No loop runs over characters.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_slices, tune

MARKERS = ("<P>", "<S>", "<M>")
#: Of a hundred texts so many are cut, and so many of these have their suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
SEED = 1
#: Bits below which a rank is counted off bit by bit.
FEW_BITS = 64

CONTINUATION = frozenset(range(0x80, 0xC0))
SPACES = frozenset(b" \t\n\v\f\r")


@functools.lru_cache(maxsize=512)
def _digits(members: frozenset[int]) -> bytes:
    """The translation of a byte to the digit 1 if it is of the class, else 0."""
    return bytes(b"01"[b in members] for b in range(256))


def mask(raw: bytes, members: Iterable[int]) -> int:
    """The integer whose bit i says whether byte i is of the class."""
    return int(raw.translate(_digits(frozenset(members)))[::-1], 2) if raw else 0


def starts(raw: bytes, unit: str = "characters") -> int:
    """Bits of the bytes at which a unit starts: a code point, a word (run of bytes other than ASCII white space) or a line.

    Bytes before the first word belong to it. The empty text has no unit.
    """
    if unit == "characters":
        return mask(raw, set(range(256)) - CONTINUATION)
    if unit == "words":
        black = mask(raw, set(range(256)) - SPACES)
        return black & ~(black << 1)
    if unit == "lines":
        return (mask(raw, b"\n") << 1 | 1) & ((1 << len(raw)) - 1)
    raise ValueError(unit)


def places(bits: int, width: int, ranks: list[int]) -> list[int]:
    """Places of the set bits of the given ranks, counted from 0; ``ranks`` increase, may repeat and are below bit_count.

    Both halves are entered only where they hold a wanted rank, so all ranks together cost a few passes over the integer.
    """
    if not ranks:
        return []
    if width <= FEW_BITS:
        found, at = [], 0
        for rank in ranks:
            while at < rank:
                bits &= bits - 1
                at += 1
            found.append((bits & -bits).bit_length() - 1)
        return found
    half = width >> 1
    low = bits & ((1 << half) - 1)
    n = low.bit_count()
    left, right = [r for r in ranks if r < n], [r - n for r in ranks if r >= n]
    return places(low, half, left) + ([half + p for p in places(bits >> half, width - half, right)] if right else [])


def holds(raw: bytes, words: Iterable[str]) -> bool:
    """Whether one of the words stands in the bytes: the masks of its bytes, each shifted to the word's start, meet."""
    known: dict[int, int] = {}
    for word in words:
        hits = -1
        for k, byte in enumerate(word.encode()):
            if byte not in known:
                known[byte] = mask(raw, (byte,))
            hits &= known[byte] >> k
            if not hits:
                break
        if hits > 0:
            return True
    return False


class Draw(NamedTuple):
    """Four numbers that decide the cuts and the form of a text."""

    first: int
    second: int
    cut: int
    order: int


def draw(doc_id: int | None, seed: int = SEED) -> Draw:
    """The first four 32-bit numbers of the SHA-256 of ``seed:doc_id``; rows without a doc_id draw alike."""
    key = f"{seed}:{'' if doc_id is None else doc_id}"
    return Draw(*struct.unpack(">4I", hashlib.sha256(key.encode()).digest()[:16]))


class Cut(NamedTuple):
    n: int
    form: str
    prefix: int | None
    middle: int | None
    output: bytes


def rearranged(raw: bytes, numbers: Draw, unit: str = "characters", markers: tuple[str, str, str] = MARKERS, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT) -> Cut:
    """One text in its form: ``plain`` as it is, ``psm`` prefix, suffix, middle, or ``spm`` suffix, prefix, middle."""
    bits = starts(raw, unit)
    n = bits.bit_count()
    if not raw or numbers.cut % 100 >= cut_percent or holds(raw, markers):
        return Cut(n, "plain", None, None, raw)
    ends = sorted((numbers.first % (n + 1), numbers.second % (n + 1)))
    found = iter(places(bits, len(raw), [e for e in ends if 0 < e < n]))
    a, b = (0 if e == 0 else len(raw) if e == n else next(found) for e in ends)
    p, s, m = (marker.encode() for marker in markers)
    if numbers.order % 100 < suffix_first_percent:
        return Cut(n, "spm", ends[0], ends[1] - ends[0], b"".join((s, raw[b:], p, raw[:a], m, raw[a:b])))
    return Cut(n, "psm", ends[0], ends[1] - ends[0], b"".join((p, raw[:a], s, raw[b:], m, raw[a:b])))


def restored(output: bytes, form: str, markers: tuple[str, str, str] = MARKERS) -> bytes:
    """The text from its output and form. A text that holds a marker is plain, so each marker of another form stands once."""
    if form == "plain":
        return output
    p, s, m = (marker.encode() for marker in markers)
    first, second = (p, s) if form == "psm" else (s, p)
    front, _, middle = output[len(first) :].partition(m)
    one, _, two = front.partition(second)
    return one + middle + two if form == "psm" else two + middle + one


def _checked(markers: tuple[str, str, str]) -> None:
    """Markers must not overlap each other, or they could arise where a marker and a text meet."""
    for a in markers:
        for b in markers:
            clash = a != b and a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b)))
            if not a or clash:
                raise ValueError(f"markers overlap: {markers}")
    if len(set(markers)) < 3:
        raise ValueError(f"markers repeat: {markers}")


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int | None, bytes]]:
    ids = batch.column(0).to_pylist()
    for first, end, data, offsets in text_slices(batch.column(1)):
        raw = data.tobytes()
        for k in range(first, end):
            yield ids[k], raw[offsets[k - first] : offsets[k - first + 1]]


def fill_in_middle(docs: DataFrame, unit: str = "characters", markers: tuple[str, str, str] = MARKERS, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT, seed: int = SEED) -> DataFrame:
    """Training texts: doc_id, n units, form, prefix_units, middle_units (null where plain) and output.

    A null text is empty; an empty text and one that holds a marker stay plain. Each row stands for itself, so repeated rows
    give repeated rows; rows without a doc_id draw the same numbers. Whole texts are cut however long they are. An empty
    table gives an empty result, and other columns are left out, whatever their names.
    """
    _checked(markers)
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, size = [], [], 0
            for doc_id, raw in _texts(batch):
                ids.append(doc_id)
                rows.append(rearranged(raw, draw(doc_id, seed), unit, markers, cut_percent, suffix_first_percent))
                size += len(raw)
                if size > 2 << 20:
                    yield _table(ids, rows)
                    ids, rows, size = [], [], 0
            if rows:
                yield _table(ids, rows)

    def _table(ids: list, rows: list[Cut]) -> pa.RecordBatch:
        n, form, prefix, middle, output = zip(*rows)
        columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(output, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    schema = "doc_id long, n long, form string, prefix_units long, middle_units long, output string"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)


def digests(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """As ``fill_in_middle`` with characters, with the digests of the output and of the text rebuilt from it.

    Nulls, empty and long texts, repeated rows, empty tables and further columns are handled as there.
    """
    tune(docs.sparkSession)
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, raw in _texts(batch):
                cut = rearranged(raw, draw(doc_id, seed))
                again = restored(cut.output, cut.form)
                rows.append((doc_id, cut.n, cut.form, cut.prefix, cut.middle, hashlib.sha256(cut.output).hexdigest(), hashlib.sha256(again).hexdigest()))
            columns = zip(*rows) if rows else [()] * len(names)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)
