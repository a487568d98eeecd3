import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from pyspark.sql import types as T

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, letters, n):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 8))) for _ in range(n))


def corpus():
    rng = random.Random(4)
    rows = []
    for d in range(120):
        lang = ["aa", "bb"][d % 2]
        rows.append([d, words(rng, {"aa": "abcdefgh", "bb": "mnopqrst"}[lang], rng.randint(40, 90)), lang])
    rows.append([200, rows[3][1] + " more", "bb"])  # near copy
    shared = words(rng, "uvwxyzé", 40)
    for d in (201, 202):
        rows.append([d, words(rng, "abcdefgh", 30) + " " + shared + " " + words(rng, "abcdefgh", 30), "aa"])
    item = words(rng, "ijkl", 30)
    rows.append([203, words(rng, "abcdefgh", 30) + "\n" + item.upper() + "\n" + words(rng, "abcdefgh", 20), "aa"])
    rows += [[204, None, None], [205, "1234 !!", "aa"], [206, "", "bb"]]
    return [(d, t, lang, "s", len(t or "")) for d, t, lang in rows], item, shared


def test_stages_take_effect(spark, tmp_path):
    rows, item, shared = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    kept = []
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    every = {r[0] for r in rows}
    assert set(kept[0]) == every - {204, 205, 206}
    assert set(kept[1]) == set(kept[0]) - {200}
    assert set(kept[2]) == set(kept[1]) and shared in kept[2][201] and shared[2:-2] not in kept[2][202]
    assert all(kept[2][d] == kept[1][d] for d in kept[2] if d != 202)
    assert "�" not in kept[2][202]
    assert set(kept[3]) == set(kept[2]) - {203}
    last = pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in last} == set(kept[3]) and all(r["n_tokens"] > 0 for r in last)


def test_empty_and_extra_columns(spark, tmp_path):
    kind = COLUMNS + ", lang_pred string, component_id int, kept int, n_bytes int"
    for n in (0, 3):
        rows = [(k, "some words here", "aa", "s", 3, "x", 1, 2, 3) for k in range(n)]
        top = tmp_path / str(n)
        spark.createDataFrame(rows, kind).write.parquet(str(top / "documents.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(top / "benchmark.parquet"))
        assert isinstance(spark.read.parquet(str(top / "documents.parquet")).schema, T.StructType)
        got = pipeline.run(spark, str(top)).collect()
        assert len(got) <= n


def test_rows_without_id_stay(spark):
    rows = [(1, "some words of a text", "aa", "s", 20), (2, "some words of a text", "aa", "s", 20), (None, "some words of a text", "aa", "s", 20), (None, None, None, "s", 0)]
    docs = spark.createDataFrame(rows, COLUMNS)
    got = pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect() if r["doc_id"]) == [(1, rows[0][1])]
    assert sorted(str(r["text"]) for r in got.collect() if r["doc_id"] is None) == ["None", rows[0][1]]


def test_the_network_decides_on_languages(spark):
    """A text in turn of three languages has letters, but the network gives none of them half of it."""
    rng = random.Random(6)
    letters = {"aa": "abcdef", "bb": "mnopqr", "cc": "uvwxyz"}
    rows = [(k, words(rng, letters[lang], 40), lang, "s", 1) for k in range(150) for lang in [["aa", "bb", "cc"][k % 3]]]
    mixed = [(900 + k, " ".join(words(rng, x, 1) for _ in range(60) for x in letters.values()), None, "s", 1) for k in (0, 1)]
    got = {r["doc_id"] for r in pipeline.language(spark, spark.createDataFrame([*rows, *mixed, (None, mixed[0][1], "aa", "s", 1)], COLUMNS), "").collect()}
    assert got == {r[0] for r in rows}
