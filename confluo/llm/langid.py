"""Language ID: a bidirectional gated recurrent network over bytes that labels every position.

Two GRUs read a text (A-Z in lower case) from either side, across words; a softmax over both states gives the languages'
probabilities at each position. A document's probabilities are the mean over all its positions but white space. States
start anew every BLOCK bytes or a little earlier, behind white space, so that the blocks of long and short texts are read
side by side; a text of up to BLOCK bytes is read in one go.

The network is trained in numpy by backpropagation through time on pieces of at most TRAIN_ROWS labelled documents of each
language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from .common import held_out, LOWER, text_slices, tidied, tune, WHITESPACE, written

#: Documents of each language that the network is trained on, and pieces of so many bytes, spread over each of them.
TRAIN_ROWS = 400
TRAIN_PIECES = 8
TRAIN_BYTES = 96
#: Pieces of each language for one epoch: drawn with replacement where there are fewer or more.
TRAIN_SHARE = 3_000
EPOCHS = 3
HIDDEN = 8
#: Bytes that are read in one go, and how much earlier white space may end a block.
BLOCK, SLACK = 256, 32
#: Bytes of texts that are worked on at once.
READ_BYTES = 1 << 20
#: Blocks that are read side by side.
SIDE_BY_SIDE = 2048
UNKNOWN = "und"
#: The ids of the training documents are broadcast up to so many, and shuffled beyond it.
BROADCAST_IDS = 500_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights: per direction the input rows (256, 3h), recurrent matrices and biases; the output layer of both."""

    def __init__(self, languages: list[str], seed: int = 3):
        rng, h, k = np.random.default_rng(seed), HIDDEN, max(1, len(languages))
        self.languages = languages
        self.p = {}
        for side in "fb":
            self.p[f"x{side}"] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            self.p[f"u{side}"] = rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32)
            self.p[f"o{side}"] = rng.normal(0, 1 / np.sqrt(h), (h, k)).astype(np.float32)
        self.p["bias"] = np.zeros(k, np.float32)

    def _run(self, codes: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        """States (T, B, h) in reading order of that side, and what backpropagation needs."""
        h, (batch, steps) = HIDDEN, codes.shape
        x, u = self.p[f"x{side}"], self.p[f"u{side}"]
        state, states, kept = np.zeros((batch, h), np.float32), np.empty((steps, batch, h), np.float32), []
        for t in range(steps):
            inp = x[codes[:, t]]
            gates = _sigmoid(inp[:, : 2 * h] + state @ u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            gated = r * state
            c = np.tanh(inp[:, 2 * h :] + gated @ u[:, 2 * h :])
            kept.append((state, z, r, gated, c))
            state = state + z * (c - state)
            states[t] = state
        return states, kept

    def positions(self, codes: np.ndarray) -> np.ndarray:
        """Probabilities (T, B, languages) at each position of runs of one length (B, T)."""
        return self._forward(codes)[0]

    def _forward(self, codes: np.ndarray):
        ahead, kept_f = self._run(codes, "f")
        back, kept_b = self._run(codes[:, ::-1], "b")
        logits = ahead @ self.p["of"] + back[::-1] @ self.p["ob"] + self.p["bias"]
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits, ahead, back, kept_f, kept_b

    def gradients(self, codes: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over all positions; every position has its run's language."""
        probs, ahead, back, kept_f, kept_b = self._forward(codes)
        steps, batch, k = probs.shape
        d = probs.copy()
        d[:, np.arange(batch), target] -= 1
        d /= steps * batch
        grads = {"bias": d.sum((0, 1)), "of": np.einsum("tbh,tbk->hk", ahead, d), "ob": np.einsum("tbh,tbk->hk", back[::-1], d)}
        self._back(codes, "f", d @ self.p["of"].T, kept_f, grads)
        self._back(codes[:, ::-1], "b", (d @ self.p["ob"].T)[::-1], kept_b, grads)
        return grads

    def _back(self, codes: np.ndarray, side: str, outer: np.ndarray, kept: list, grads: dict) -> None:
        h, u = HIDDEN, self.p[f"u{side}"]
        gx, gu = np.zeros_like(self.p[f"x{side}"]), np.zeros_like(u)
        ds = np.zeros_like(outer[0])
        for t in range(len(kept) - 1, -1, -1):
            state, z, r, gated, c = kept[t]
            ds = ds + outer[t]
            dc = ds * z * (1 - c * c)
            dgated = dc @ u[:, 2 * h :].T
            dz = ds * (c - state) * z * (1 - z)
            dr = dgated * state * r * (1 - r)
            dzr = np.concatenate([dz, dr], 1)
            gu[:, : 2 * h] += state.T @ dzr
            gu[:, 2 * h :] += gated.T @ dc
            np.add.at(gx, codes[:, t], np.concatenate([dzr, dc], 1))
            ds = ds * (1 - z) + dgated * r + dzr @ u[:, : 2 * h].T
        grads[f"x{side}"], grads[f"u{side}"] = gx, gu

    def fit(self, runs: list[bytes], target: np.ndarray, seed: int = 5) -> None:
        """Adam over minibatches of runs of one length."""
        rng, step = np.random.default_rng(seed), 0
        by_length: dict[int, list[int]] = {}
        for i, r in enumerate(runs):
            by_length.setdefault(len(r), []).append(i)
        codes = {n: np.frombuffer(b"".join(runs[i] for i in own), np.uint8).reshape(len(own), n) for n, own in by_length.items()}
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        for epoch in range(EPOCHS):
            batches = []
            for n, own in by_length.items():
                order = rng.permutation(len(own))
                batches += [(n, order[at : at + 128]) for at in range(0, len(own), 128)]
            rate = 0.02 * (1 - epoch / EPOCHS)
            for i in rng.permutation(len(batches)):
                n, some = batches[i]
                step += 1
                grads = self.gradients(codes[n][some], target[np.array(by_length[n])[some]])
                for k, g in grads.items():
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    self.p[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)


def blocks_of(lower: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the blocks of all rows, in order."""
    size = np.diff(offsets)
    many = -(-size // BLOCK)
    row = np.repeat(np.arange(len(size)), many)
    starts = offsets[row] + BLOCK * (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many))
    if not len(starts):
        return starts, starts
    inner = starts > offsets[row]
    space = np.maximum.accumulate(np.where(WHITESPACE[lower], np.arange(len(lower)), -BLOCK))[np.maximum(starts - 1, 0)]
    starts = np.where(inner & (starts - 1 - space < SLACK), space + 1, starts)
    return starts, np.r_[np.where(row[1:] == row[:-1], starts[1:], offsets[row[:-1] + 1]), offsets[row[-1] + 1]]


def labelled(network: Network, lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Probabilities (bytes, languages) at every position of the blocks.

    Blocks are read side by side, longest first, so that those not yet at their end are always the first ones.
    """
    logits = np.zeros((len(lower), len(network.languages)), np.float32)
    order = np.argsort(starts - ends, kind="stable")
    for at in range(0, len(order), SIDE_BY_SIDE):
        some = order[at : at + SIDE_BY_SIDE]
        first, last = starts[some], ends[some] - 1
        steps = np.searchsorted(-(last + 1 - first), -np.arange(int(last[0] + 1 - first[0])))  # blocks longer than t
        for side, begin, way in (("f", first, 1), ("b", last, -1)):
            x, u, out = network.p[f"x{side}"], network.p[f"u{side}"], network.p[f"o{side}"]
            h = u.shape[0]
            gates_u, new_u = np.ascontiguousarray(u[:, : 2 * h]), np.ascontiguousarray(u[:, 2 * h :])
            state = np.zeros((len(some), h), np.float32)
            for t, k in enumerate(steps.tolist()):
                place = begin[:k] + way * t
                inp, own = x.take(lower[place], axis=0), state[:k]
                gates = own @ gates_u
                gates += inp[:, : 2 * h]
                gates *= 0.5
                np.tanh(gates, out=gates)
                gates += 1
                gates *= 0.5  # the logistic of the sum
                new = (gates[:, h:] * own) @ new_u
                new += inp[:, 2 * h :]
                np.tanh(new, out=new)
                new -= own
                new *= gates[:, :h]
                own += new
                logits[place] += own @ out
    logits += network.p["bias"]
    logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(1, keepdims=True)
    return logits


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode())


def train(docs: DataFrame) -> Network:
    """Train on documents with text and language whose doc_id is not held out: of each language the TRAIN_ROWS with the
    smallest hashes of doc_id.

    What reaches the driver is bounded by language: TRAIN_PIECES pieces of TRAIN_BYTES, spread evenly over each document.
    Equal rows count once for the choice. A language of fewer documents is learned from all it has.
    """
    tune(docs.sparkSession)
    known = docs.selectExpr("cast(doc_id as long) as doc_id", "lang", "text").where("doc_id is not null and lang is not null and length(text) > 0").where(~held_out())
    # hashes below a language's share are a few more than TRAIN_ROWS, so that no task ranks more than that
    counts = written(known.groupBy("lang").agg(F.count("*").alias("_n")), "languages")
    few = counts.count() * TRAIN_ROWS <= BROADCAST_IDS
    ids = known.select("lang", "doc_id", F.xxhash64("text").alias("_text")).join(F.broadcast(counts) if few else counts, "lang")
    share = (F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 62) - 1)) / float(1 << 62)).alias("_share")
    ids = ids.select("*", share).where(F.col("_share") <= (TRAIN_ROWS + 8 * TRAIN_ROWS**0.5) / F.col("_n"))
    first = W.partitionBy("lang").orderBy("_share", "doc_id", "_text")
    ids = ids.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= TRAIN_ROWS).select("lang", "doc_id", "_text").distinct()
    if few:
        ids = F.broadcast(ids)
    chosen = known.withColumn("_text", F.xxhash64("text")).join(ids, ["lang", "doc_id", "_text"], "left_semi").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, piece = [], []
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes()
                most = max(0, len(raw) - TRAIN_BYTES)
                for at in sorted({most * k // (TRAIN_PIECES - 1) for k in range(TRAIN_PIECES)}):
                    lang.append(own)
                    piece.append(raw[at : at + TRAIN_BYTES])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(piece, pa.binary())], names=["lang", "piece"])

    rows = sorted((lang, bytes(piece)) for lang, piece in chosen.mapInArrow(tidied(run), "lang string, piece binary").collect())
    languages = sorted({lang for lang, _ in rows})
    network = Network(languages)
    if len(languages) < 2:
        return network
    rng = np.random.default_rng(1)
    runs, target = [], []
    for k, lang in enumerate(languages):
        own = [piece for its, piece in rows if its == lang]
        some = rng.permutation(len(own))[:TRAIN_SHARE] if len(own) >= TRAIN_SHARE else rng.choice(len(own), TRAIN_SHARE)
        runs += [own[i] for i in some]
        target += [k] * len(some)
    network.fit(runs, np.array(target))
    return network


PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def predicted(docs: DataFrame, network: Network) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the mean probability of that language over the positions) of every row.

    A null text, or one without letters, is ``und`` with score 0, as is everything if nothing was learned. Every row stands
    for itself; a null doc_id is not held out. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return with_prediction(rows, network, "text").select("doc_id", "held_out", "lang_pred", "score")


def with_prediction(docs: DataFrame, network: Network, column: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two columns added, the language and its score (columns of these names are replaced)."""
    tune(docs.sparkSession)
    docs = docs.drop(*names)
    at = docs.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in text_slices(batch.column(at), READ_BYTES):
                lower, many = LOWER[data], end - start
                sums, n = np.zeros((many, max(1, len(network.languages)))), np.zeros(many)
                if len(lower) and network.languages:
                    found = labelled(network, lower, *blocks_of(lower, offsets))  # a row for each byte of the slice
                    black = np.flatnonzero(~WHITESPACE[lower])
                    row = np.repeat(np.arange(many), np.diff(offsets))[black]
                    n = np.bincount(row, minlength=many)
                    for k in range(found.shape[1]):
                        sums[:, k] = np.bincount(row, found[black, k], many)
                    del found, black, row
                best = sums.argmax(1)
                score = sums[np.arange(many), best] / np.maximum(n, 1)
                letters = (lower >= 0x61) & (lower <= 0x7A)
                sure = np.diff(np.concatenate([[0], np.cumsum(letters)])[offsets]) > 0
                found_names = []
                for k in range(many):
                    ok = network.languages and n[k] and (sure[k] or has_letter(data[offsets[k] : offsets[k + 1]].tobytes()))
                    found_names.append(network.languages[best[k]] if ok else UNKNOWN)
                    if not ok:
                        score[k] = 0
                kept = [c.slice(start, many) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found_names, pa.string()), pa.array(np.clip(score, 0, 1))], names=[*batch.schema.names, *names])

    schema = StructType(list(docs.schema)).add(names[0], "string").add(names[1], "double")
    return docs.mapInArrow(tidied(run), schema)


def language_id(docs: DataFrame) -> DataFrame:
    """``predicted`` by a network trained on the documents themselves; an empty table gives no rows."""
    return predicted(docs, train(docs))
