"""What the findings of the third round ask for: work that follows the input, and results as they were."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.functions import text as tx
from textquarry.operators import blocks as bk
from textquarry.operators import bm25
from textquarry.plans import base

SF = "/root/testdata/sf0.001"
RNG = np.random.default_rng(11)


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("findings") / "own")
    texts = [" ".join(f"w{int(i)}" for i in np.minimum(RNG.zipf(1.4, 5 + d % 30), 80)) for d in range(600)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    bm25.write(frame, path, tokenizer=tx.lower_words)
    return texts, bm25.Index.load(spark, path)


@pytest.mark.parametrize("method", ["robertson", "atire"])
def test_scores_above_a_mark_are_counted_without_the_rest(spark, index, method, monkeypatch):
    texts, own = index
    own = bm25.Index.load(spark, own.path.removesuffix("/lookup"), method)
    asked = spark.createDataFrame([(q, texts[q % 200].split()) for q in range(0, 400, 3)], "query_id long, tokens array<string>")
    weighted = bm25.weighted_terms(asked, own)
    truth = asked.select("query_id", F.col("query_id").alias("doc_id"))
    targets = bm25.pair_scores(weighted, own, truth).where("score > 0")
    want = {(r.query_id, r.greater, r.equal) for r in bm25.counts(weighted, own, targets).where("equal > 0").collect()}
    assert {tuple(r) for r in bm25.above(weighted, own, targets).collect()} == want and want


def test_a_mark_spares_documents(index):
    """With a mark, rows of low bounds are looked up for the documents met alone, and equal queries are scored once."""
    texts, own = index
    rows = own.blocks.select("term", "max_tf", "min_dl", "at", "tf", "ids", "dl").toArrow().combine_chunks()
    import pyarrow as pa

    kind = pa.list_(pa.struct([("query_id", pa.int64()), ("value", pa.float64()), ("target", pa.int64())]))
    terms = rows["term"].to_pylist()
    asked = [[{"query_id": q, "value": 5.0, "target": None} for q in (1, 2)] if t == "" else [{"query_id": q, "value": 4.0 if t == "w30" else 0.1, "target": None} for q in (1, 2, 3)] for t in terms]
    table = rows.append_column("asked", pa.array(asked, kind))
    calls, seen = [], bk.Block.scores

    class Watched(bk.Above):
        def add(self, block):
            block.scores = lambda *a: calls.append(a) or seen(block, *a)
            return super().add(block)

    out = pa.Table.from_batches(bk.walk(Watched, own.avgdl, 1.5, 0.75)(iter(table.to_batches())))
    blocks = sum(t == "" for t in terms)
    assert len(calls) == blocks and {a[2] for a in calls} == {5.0}  # query 3 has no mark, 1 and 2 are alike
    assert out.num_rows == 2 or out.num_rows == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_ranks_are_found_once(spark, monkeypatch):
    """A rank is joined, numbered and averaged: the blocks are walked before, once."""
    made = base.paired_counts(spark, SF)
    assert "MapInArrow" not in made._jdf.queryExecution().executedPlan().toString()


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def test_slices_are_bounded_by_their_contents():
    import pyarrow as pa

    from textquarry.functions import bpe

    texts = [None, "é" * 5, "", "a" * 30, "b", "c" * 9, None]
    ids = [None if t is None else list(range(len(t))) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "text", "ids"])
    for column in (1, 2):
        made = list(bpe.slices(iter([batch, batch.slice(0, 0)]), column, 10))
        assert [d for b in made for d in b.column(0).to_pylist()] == list(range(7))
        sizes = [sum(len(x.encode() if column == 1 else x) for x in b.column(column).to_pylist() if x) for b in made]
        assert all(size <= 10 or b.num_rows == 1 for size, b in zip(sizes, made))


@pytest.mark.skipif(not os.path.isfile(VOCABULARY), reason="no vocabulary")
def test_ids_don_t_follow_the_slices(spark):
    from textquarry.functions import bpe

    texts = ["word " * 150_000, None, "", *[f"héllo {i} world " * (i % 40) for i in range(400)], "last " * 120_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    own = bpe.vocabulary(VOCABULARY)
    for size in (None, 16):
        for r in bpe.encode(docs, VOCABULARY, size, "text").collect():
            ids = own.encode("<TEXT> " + (texts[r.doc_id] or ""), add_special_tokens=False).ids
            want = ids if size is None else (ids + [0] * size)[:size]
            assert r.ids == want and r.n_tokens == len(ids) and sum(r.mask) == min(len(ids), len(want))
    back = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs, VOCABULARY, None, "text"), VOCABULARY).collect()}
    assert all(back[i] == bpe.vocabulary(VOCABULARY).decode(own.encode("<TEXT> " + (t or ""), add_special_tokens=False).ids) for i, t in enumerate(texts))


@pytest.mark.parametrize("hot", [0, 10_000])
def test_near_documents_by_hashes_and_hot_keys(spark, monkeypatch, hot):
    """Large groups of copies and documents that only another than a band's first one is near to, with and without keys that
    are broadcast; only candidates' texts are cut into shingles."""
    from textquarry.operators import dedup

    monkeypatch.setattr(dedup, "HOT", hot)
    words = lambda n: [f"x{int(i)}" for i in RNG.integers(0, 5000, n)]
    first = words(80)
    texts = [" ".join(first)] * 30 + [" ".join([*first[:k], "new", *first[k + 1 :]]) for k in range(0, 80, 2)]
    texts += [" ".join([*first[: 80 - 3 * k], *words(3 * k)]) for k in range(1, 12)] + [" ".join(words(60)) for _ in range(40)] + ["", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    signed = dedup.signatures(docs).cache()
    a, b = docs.where("doc_id % 3 = 0"), docs.where("doc_id % 3 > 0")
    sa, sb = signed.where("doc_id % 3 = 0"), signed.where("doc_id % 3 > 0")
    want = {r.doc_id for r in dedup.near_pairs(sa, sb, a, b).collect()}
    assert {r.doc_id for r in dedup.near_any(sa, sb, a, b).collect()} == want and want
    stars = {(r.doc_id, r.other_id) for r in dedup.star_pairs(signed.where("n_shingles > 0"), signed.where("n_shingles > 0")).collect()}
    own = dedup.bands(signed.where("n_shingles > 0"))
    first_of = own.groupBy("band", "key").agg(F.min("doc_id").alias("other_id"))
    assert stars == {(r.doc_id, r.other_id) for r in own.join(first_of, ["band", "key"]).select("doc_id", "other_id").collect()}


def test_a_text_and_its_change_are_compared_in_place(spark):
    from textquarry.operators import dedup

    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (3, ""), (4, "a a a a"), (5, "x y")], "doc_id long, text string")
    made = dedup.compared(docs, F.concat("text", F.lit(" h i")))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    changed = dedup.shingled(docs.select("doc_id", F.concat("text", F.lit(" h i")).alias("text"))).withColumnRenamed("shingles", "other")
    want = dedup.shingled(docs).join(changed, "doc_id").select("doc_id", tx.jaccard(F.col("shingles"), F.col("other")).alias("j"))
    assert {tuple(r) for r in made.collect()} == {tuple(r) for r in want.collect()}


def test_nearest_texts_in_blocks(spark):
    """As the search by pairs finds them, over several groups and blocks, with copies, empty texts, and a half that rounds up."""
    from textquarry.operators import dedup

    words = [f"n{int(i)}" for i in np.minimum(RNG.zipf(1.3, 3000), 40)]
    texts = [" ".join(words[i : i + i % 17]) for i in range(0, 900, 5)] + ["", None, "one"]
    # one shingle of 128 in common: 0.0078125
    texts += [" ".join(["q r s", *[f"u{i}" for i in range(63)]]), " ".join(["q r s", *[f"v{i}" for i in range(64)]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for part in ("doc_id % 4 = 1", "doc_id % 2 = 1", "doc_id < 0"):
        a, b = docs.where(part), docs.where(f"NOT ({part})")
        want = {tuple(r) for r in dedup.exact_nearest(dedup.shingled(a), dedup.shingled(b)).collect()}
        made = dedup.nearest_texts(a, b, group=150, block=200)
        assert {tuple(r) for r in made.collect()} == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_mix_is_range_sorted(spark):
    from textquarry.llm import mixing

    made = mixing.op8_mixing(spark, SF)
    rows = made.withColumn("part", F.spark_partition_id()).collect()
    key = lambda r: (r.position is not None, r.position or 0.0, r.doc_id)
    assert "rangepartitioning" in made._jdf.queryExecution().executedPlan().toString()
    assert [(r.part, *key(r)) for r in rows] == sorted((r.part, *key(r)) for r in rows)
    assert [key(r) for r in rows] == sorted(key(r) for r in rows)


@pytest.mark.parametrize("method", ["robertson", "atire"])
def test_queries_are_counted_together(spark, index, method, monkeypatch):
    """Counts of many queries at once, a few lists looked up and the rest added up, are those of all scores; so are own scores
    from texts."""
    texts, own = index
    own = bm25.Index.load(spark, own.path.removesuffix("/lookup"), method)
    asked = spark.createDataFrame([(q, (texts[q] + " " + texts[(7 * q) % 600]).split()[: 3 + q % 40]) for q in range(600)], "query_id long, tokens array<string>")
    weighted = bm25.weighted_terms(asked, own)
    tokens = spark.createDataFrame([(d, t.split()) for d, t in enumerate(texts)], "doc_id long, tokens array<string>")
    targets = bm25.pair_scores(weighted, own, asked.select("query_id", F.col("query_id").alias("doc_id"))).where("score > 0").cache()
    assert {tuple(r) for r in bm25.own_scores(weighted, own, tokens).where("score > 0").collect()} == {tuple(r) for r in targets.collect()}
    want = {(r.query_id, r.greater, r.equal) for r in bm25.counts(weighted, own, targets).where("equal > 0").collect()}
    assert {tuple(r) for r in bm25.above(weighted, own, targets).collect()} == want and len(want) > 500


@pytest.mark.parametrize("size, sums", [(16, 1 << 18), (1, 1), (2, 500)])
def test_scores_of_queries_together(index, size, sums, monkeypatch):
    """Whatever is added up or looked up, and however many queries are taken at once, each gets what it gets alone."""
    import pyarrow as pa

    monkeypatch.setattr(bk, "COMMON", size)
    monkeypatch.setattr(bk, "TOGETHER_SUMS", sums)
    rows = index[1].blocks.where("n is null or n > 0").select("term", "max_tf", "min_dl", "at", "tf", "ids", "dl").toArrow()
    kind = pa.list_(pa.struct([("query_id", pa.int64()), ("value", pa.float64()), ("target", pa.int64())]))
    entry = lambda q, x: {"query_id": q, "value": x, "target": None}
    terms = rows["term"].to_pylist()
    asked = [[entry(q, 1.0) for q in range(40)] if t == "" else [entry(q, 0.5 + (len(t) + q) % 5) for q in range(40) if (sum(map(ord, t)) + q) % 3 == 0] for t in terms]
    table = rows.append_column("asked", pa.array(asked, kind)).combine_chunks()
    first = [i for i, t in enumerate(terms) if t == ""] + [len(terms)]
    for low, high in zip(first, first[1:]):
        block = bk.Block(table.slice(low, high - low).combine_chunks().to_batches(), 20.0, 1.5, 0.75)
        which = np.arange(block.starts.size - 1)
        for least in (0.1, 3.0, 12.0):
            made = list(bk.reaching(block, which, np.full(which.size, least)))
            assert len(made) == which.size
            for i, (at, s) in zip(which, made):
                part = slice(block.starts[i], block.starts[i + 1])
                places, want = block.scores(block.row[part], block.weight[part])
                assert dict(zip(at[s >= least].tolist(), s[s >= least].tolist())) == pytest.approx(dict(zip(places[want >= least].tolist(), want[want >= least].tolist())), abs=2e-6)


def test_the_best_of_many_queries_over_blocks_of_a_task(spark, index):
    """Behind a task's first block, queries are scored together; a task takes several blocks, whatever the number of files."""
    texts, own = index
    asked = spark.createDataFrame([(q, texts[q].split()[: 2 + q % 9]) for q in range(300)], "query_id long, tokens array<string>")
    weighted = bm25.weighted_terms(asked, own)
    want = sorted(tuple(r) for r in bm25.top_k(bm25.scores(None, own, weighted=weighted), 4).collect())
    made = bm25.top_k(bm25.walked(weighted, own, lambda: bk.Best(4), bk.PAIRS, tasks=1), 4)
    assert sorted(tuple(r) for r in made.collect()) == want
    assert bm25.walked(weighted, own, lambda: bk.Best(4), bk.PAIRS, tasks=2).rdd.getNumPartitions() <= 2
    assert "Coalesce" in bm25.best(None, own, 4, weighted=weighted)._jdf.queryExecution().executedPlan().toString()


def test_no_null_lists_meet_the_arrow_stage(spark, index):
    """Null lists make the Arrow writer's work grow with the square of a batch's rows."""
    own = index[1]
    assert own.blocks.where("ids is null").count() > 0
    assert bm25.full_lists(own.blocks).where("ids is null or dl is null or at is null or tf is null").count() == 0
    asked = spark.createDataFrame([(1, ["w1"])], "query_id long, tokens array<string>")
    plan = bm25.walked(bm25.weighted_terms(asked, own), own, bk.Every, bk.PAIRS)._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce(ids" in plan


def test_blocks_are_bounded_by_their_tokens(monkeypatch):
    """A block ends behind the document that fills it, however many documents a batch brings."""
    import pyarrow as pa

    monkeypatch.setattr(bk, "BLOCK_TOKENS", 50)
    tokens = [[f"t{int(x)}" for x in RNG.integers(0, 30, n)] for n in [*RNG.integers(0, 20, 300), 200, 0, 49, 1, 50]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(tokens))), pa.array([None if i == 7 else t for i, t in enumerate(tokens)], pa.list_(pa.string()))], names=["doc_id", "tokens"])
    made = list(bk.cut(iter([batch.slice(0, 120), batch.slice(120, 0), batch.slice(120)])))
    heads = [b.slice(0, 1).to_pylist()[0] for b in made]
    assert [i for h in heads for i in h["ids"]] == list(range(len(tokens)))
    assert all(sum(h["dl"][:-1]) < 50 for h in heads) and all(sum(h["dl"]) >= 50 for h in heads[:-1])
    assert sum(sum(b.column("cf").to_pylist()[1:]) for b in made) == sum(len(t) for i, t in enumerate(tokens) if i != 7)
