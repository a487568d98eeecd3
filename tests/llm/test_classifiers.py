import random

import numpy as np
import pytest

langid = pytest.importorskip("confluo.llm.langid")
toxicity = pytest.importorskip("confluo.llm.toxicity")


def words(rng, letters, n):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(n))


def test_gradients_are_those_of_the_loss():
    net = langid.Network(["a", "b", "c"])
    rng = np.random.default_rng(0)
    codes, target = rng.integers(97, 100, (3, 5)).astype(np.uint8), np.array([0, 2, 1])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        p = net.positions(codes)
        return -np.log(p[:, np.arange(3), target]).mean()

    grads = net.gradients(codes, target)
    for name, value in net.p.items():
        flat, g = value.reshape(-1), grads[name].reshape(-1)
        for i in np.argsort(-np.abs(g))[:3]:
            old = flat[i]
            flat[i] = old + 1e-3
            up = loss()
            flat[i] = old - 1e-3
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-3 - g[i]) < 1e-3 + 0.02 * abs(g[i])


def test_language_of_held_out_documents(spark):
    rng = random.Random(3)
    letters = {"aa": "abcdeftr", "bb": "uvwxyzkm", "cc": "äöüßnlio"}
    rows = [(k, words(rng, letters[lang], rng.randint(3, 60)), lang) for k in range(300) for lang in [rng.choice(list(letters))]]
    extra = [(1000, None, "aa"), (1001, "123 !! 45", "aa"), (1002, "", None), (None, words(rng, letters["bb"], 20), None)]
    got = langid.language_id(spark.createDataFrame([(*r, 1.0) for r in rows + extra], "doc_id long, text string, lang string, score double")).collect()
    found = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + 4
    tested = [(found[d]["lang_pred"], lang) for d, _, lang in rows if found[d]["held_out"]]
    assert len(tested) > 30 and sum(a == b for a, b in tested) >= 0.97 * len(tested)
    assert [found[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3 and found[None]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got)
    none = langid.language_id(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert none["lang_pred"] == "und"
    assert langid.language_id(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def naive(net, raw):
    """Probabilities at every position of one block, byte by byte."""
    h, states = net.p["uf"].shape[0], {}
    for side, way in (("f", 1), ("b", -1)):
        state, own = np.zeros(h), []
        for byte in raw[::way]:
            inp, u = net.p[f"x{side}"][byte].astype(float), net.p[f"u{side}"].astype(float)
            z, r = np.split(1 / (1 + np.exp(-(inp[: 2 * h] + state @ u[:, : 2 * h]))), 2)
            state = state + z * (np.tanh(inp[2 * h :] + (r * state) @ u[:, 2 * h :]) - state)
            own.append(state @ net.p[f"o{side}"])
        states[side] = np.array(own)[::way]
    logits = np.exp(states["f"] + states["b"] + net.p["bias"])
    return logits / logits.sum(1, keepdims=True)


def test_every_position_is_labelled_across_words():
    """The ragged pass gives what reading each block byte by byte gives, and blocks cover every byte once."""
    net = langid.Network(["a", "b", "c"])
    texts = [b"one two  one ", b"", b"x" * 700, b"some words " * 60, "äöü ".encode() * 90, b"z"]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t) for t in texts])]
    starts, ends = langid.blocks_of(raw, offsets)
    assert np.array_equal(np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)]), np.arange(len(raw)))
    assert (ends - starts).max() <= langid.BLOCK + langid.SLACK and set(offsets[:-1][np.diff(offsets) > 0]) <= set(starts)
    got = langid.labelled(net, raw, starts, ends)
    for a, b in zip(starts, ends):
        assert np.allclose(got[a:b], naive(net, raw[a:b]), atol=1e-4)
    assert not np.allclose(got[4:7], got[9:12], atol=1e-3)  # the same word in other company


def test_document_scores_are_means_over_positions(spark):
    net = langid.Network(["a", "b"])
    texts = ["one two  one", "x" * 900, "Some Words " * 40, None, "", "12 34"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.predicted(rows, net).collect():
        text = (texts[r["doc_id"]] or "").lower()
        if not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        raw = np.frombuffer(text.encode(), np.uint8)
        probs = np.concatenate([naive(net, raw[a:b]) for a, b in zip(*langid.blocks_of(raw, np.array([0, len(raw)])))])
        mean = probs[raw != 0x20].mean(0)
        assert r["lang_pred"] == net.languages[mean.argmax()] and abs(r["score"] - mean.max()) < 1e-4


def test_rare_languages_are_learned(spark):
    """A language of few documents among many others can be predicted."""
    rng = random.Random(5)
    rows = [(k, words(rng, "abcdefg", 30), "aa") for k in range(900)] + [(5000 + k, words(rng, "uvwxyz", 30), "bb") for k in range(12)]
    got = langid.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r["lang_pred"] == ("bb" if r["doc_id"] >= 5000 else "aa") for r in got)


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(900):
        text, toxic = words(rng, "abcdefg", rng.randint(5, 80)), int(rng.random() < 0.2)
        if toxic:
            parts = text.split(" ")
            parts.insert(rng.randrange(len(parts)), rng.choice(["Vile!", "NASTY,", "foul"]))
            text = " ".join(parts)
        docs.append((k, text, 0.5))
        labels.append((k, 1, toxic if k % 50 else None))
    docs += [(5000, None, 0.1), (None, "", 0.1)]
    got = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    found = {r["doc_id"]: r for r in got}
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    tested = [(found[d]["predicted"], t) for d, _, t in labels if t is not None and found[d]["held_out"]]
    assert sum(a == b for a, b in tested) >= 0.97 * len(tested)


def test_pairs_beyond_single_terms():
    """Neither term alone is toxic; together they are."""
    rng = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        rows.append(np.array([1] * int(a) + [2] * int(b) + [3 + int(rng.integers(50))], np.int32))
        y.append(int(a and b) if rng.random() < 0.98 else 0)
    machine = toxicity.fit(rows, np.array(y))
    score = [scored(machine, own) for own in ([], [1], [2], [1, 2])]
    assert score[3] > 0.8 and max(score[:3]) < 0.2 and np.abs(machine.factors).max() > 0.1


def scored(machine, own):
    terms = machine.slot[np.array(own, np.int64)]
    terms = terms[terms >= 0]
    return float(machine.score(terms, np.array([len(terms)]))[0])


def test_terms_that_only_matter_together():
    """Exactly one of two terms is toxic: neither differs by label alone, and only a pair weight tells them apart."""
    rng = np.random.default_rng(4)
    rows, y = [], []
    for _ in range(6000):
        a, b = rng.random(2) < 0.5
        rows.append(np.unique(np.r_[[1] * int(a) + [2] * int(b), 3 + rng.integers(0, 400, 12)]).astype(np.int32))
        y.append(int(a != b))
    machine = toxicity.fit(rows[:5000], np.array(y[:5000]))
    guess = np.array([scored(machine, r) >= 0.5 for r in rows[5000:]])
    assert (guess == np.array(y[5000:])).mean() > 0.95


def test_pairs_are_learned_from_as_many_rows_as_are_taken():
    """A hundred texts with two terms among 20,000 rows, four times as many with either alone: the pair counts, the parts do not."""
    rng = np.random.default_rng(0)
    share = 1 / np.arange(1, 5001)
    background = lambda: set((rng.choice(5000, 30, p=share / share.sum()) + 100).tolist())
    rows = [background() | ({1, 2} if i < 100 else {1} if i < 500 else {2} if i < 900 else set()) for i in range(toxicity.TRAIN_ROWS)]
    machine = toxicity.fit([np.array(sorted(r), np.int32) for r in rows], (np.arange(len(rows)) < 100).astype(np.int64))

    def median(extra):
        known = [machine.slot[np.array(sorted(background() | extra))] for _ in range(200)]
        known = [k[k >= 0] for k in known]
        return np.median(machine.score(np.concatenate(known), np.array([len(k) for k in known])))

    assert median({1, 2}) > 0.8 and median({1}) < 0.05 and median({2}) < 0.05 and median(set()) < 0.01


def test_scores_are_those_of_the_formula(spark):
    """Whole texts, long ones too, against the sum over all pairs; terms that come again count once."""
    rng = np.random.default_rng(1)
    size = 1 << toxicity.BUCKET_BITS
    machine = toxicity.Machine(np.arange(size, dtype=np.int32), -1.0, rng.normal(0, 0.1, size).astype(np.float32), rng.normal(0, 0.05, (size, toxicity.RANK)).astype(np.float32))
    texts = ["", None, "One two one TWO three", " ".join(f"w{k % 700}" for k in range(300_000)), "it's  it's"]
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), machine).collect()}
    for k, text in enumerate(texts):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        terms = np.unique(toxicity.term_rows(raw, np.array([0, len(raw)]))[1])
        assert len(terms) >= len(set((text or "").lower().split())) - 2  # terms of one bucket are one term
        w, v = machine.weights[terms].astype(float), machine.factors[terms].astype(float)
        pairs = (v @ v.T)[np.triu_indices(len(terms), 1)].sum()
        assert abs(got[k] - 1 / (1 + np.exp(1 - w.sum() - pairs))) < 1e-3


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, none).first()["score"] == 0.5
    assert toxicity.toxicity(docs.limit(0), none).count() == 0
