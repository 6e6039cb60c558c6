"""Every query and every pipeline stage over nulls in all columns, empty and long texts, repeated rows, clashing names and empty tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textquarry.llm import language_id, media, quality, registry, simhash

PASSAGE = " ".join(f"planted{i}" for i in range(40))
LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, fp long, items string, part long, key string, h string, Accepted string, arrival string, shard_place string, quality_score string, contamination string, at string, place string, `__run` string, `__row` string, `a.b` string"
TAIL = (0.5, "r", 3, "i", 4, "k", "h", None, "x", "x", "x", None, "x", "x", "x", "x", "x")
ROWS = [
    (1, "a plain text of several words", "en", "s", 29, *TAIL), (2, "a plain text of several words", "en", "s", 29, *TAIL), (3, PASSAGE, "de", "t", 1, *TAIL),
    (4, None, None, None, None, *TAIL), (5, "", "en", "s", 0, *TAIL), (6, LONG, "en", "s", len(LONG), *TAIL), (6, LONG, "en", "s", len(LONG), *TAIL),
    (None, "no identifier but a text", "en", "s", 24, *TAIL), (None, "no identifier but a text", "en", "s", 24, *TAIL), (None, "another one without", None, None, 19, *TAIL),
    (None,) * 22, (7, "\n\n\n", "fr", "t", 3, *TAIL), (8, "été \U0001f600\x00 end", "fr", "t", 9, *TAIL),
]


@pytest.fixture(scope="module", params=["edges", "empty"])
def folder(spark, request, tmp_path_factory):
    """A folder of tables: the rows above, or none at all."""
    made = str(tmp_path_factory.mktemp(request.param))
    full = request.param == "edges"
    spark.createDataFrame(ROWS if full else [], SCHEMA).repartition(3).write.parquet(f"{made}/documents.parquet")
    items = [(1, PASSAGE, "x"), (1, "several words", "x"), (2, None, "x"), (None, "no identifier", None), (3, "", "x")] if full else []
    spark.createDataFrame(items, "item_id long, text string, row string").write.parquet(f"{made}/benchmark.parquet")
    spark.createDataFrame([(1, None, 0), (None, 1, 0), (99, 1, 1)] if full else [], "doc_id long, quality int, toxic int").write.parquet(f"{made}/labels.parquet")
    return made


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"op11_filter_audit"}))  # its rows are parts and orders
def test_query_gives_a_row_per_document(spark, folder, name):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made = registry.QUERIES[name](spark, folder)
    assert Counter(r.doc_id for r in made.collect()) == Counter(r.doc_id for r in docs.select("doc_id").collect())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_keeps_rows_as_they_are(spark, folder, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made = stage(spark, docs, folder)
    assert made.columns[: len(docs.columns)] == docs.columns
    before, after = (Counter(map(repr, d.select([f"`{c}`" for c in docs.columns]).collect())) for d in (docs, made))
    if name in ("quality", "sharding"):  # without labels to learn from nothing is rejected
        assert after == before
    elif name == "mixing":
        assert all(n <= 2 * before[row] for row, n in after.items())
    elif name == "near_dedup":
        # two texts without an id, far apart, form groups of their own
        groups = {(r.component_id, r.fp if r.component_id is None else 0) for r in simhash.near_duplicates(docs).collect()}
        assert not after - before and Counter(r.doc_id for r in made.collect()) == Counter(i for i, _ in groups)
    else:
        gone = before - after
        assert not after - before and all("planted" in row or "several words" in row or "no identifier" in row for row in gone) and bool(gone) == bool(before)


def test_pipeline_of_edges(spark, folder):
    made = corpus_pipeline.run(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert made.columns[: len(docs.columns)] == docs.columns
    assert {r.doc_id for r in made.collect()} <= {r.doc_id for r in docs.collect()}


def test_new_columns_replace_their_namesakes(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    made = language_id.predict(docs, None)
    assert made.columns == [c for c in docs.columns if c not in ("score", "Accepted")] + ["lang_pred", "score", "accepted"]
    assert {r.score for r in made.select("score").collect()} == {0.0}
    scored = quality.score(docs, quality.train(np.zeros((0, len(quality.FEATURES))), np.zeros(0)))
    assert scored.columns == [c for c in docs.columns if c != "score"] + ["score"] and scored.where(F.col("score") != 0.5).count() == 0


def test_broken_images_say_so():
    r = np.random.default_rng(5)
    image = r.integers(0, 256, (4, 3, 3)).astype(np.uint8)
    whole = [media.encode_ppm(bytes(media.UNIT)), b"P6 3 4 255\n" + image.tobytes(), b"P3 1 1 255\n1 2 3", b"P1\n3 1\n1 0 1", b"P4\n3 1\n\xa0", b"P6 99999999 99999999 255\n1", b"P5 2 2 0\n1234"]
    head = b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (3).to_bytes(4, "little") + (4).to_bytes(4, "little") + b"\1\0\x18\0" + bytes(24)
    whole.append(head + bytes(48))
    for data in whole:
        for k in range(400):
            broken = bytearray(data[: r.integers(0, len(data) + 1)] if k % 2 else data)
            for _ in range(k % 4):
                if broken:
                    broken[r.integers(0, min(len(broken), 60))] = r.integers(0, 256)
            try:
                assert media.decode(bytes(broken)).ndim in (2, 3)
            except media.MediaError:
                pass
