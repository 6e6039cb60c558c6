"""The pipeline against a brute-force version of each stage, on the smallest tables."""

import hashlib
import os
import re
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

import pytest

import corpus_pipeline
from textquarry.llm import decontamination, mixing, quality, sharding, simhash

SF = "/root/testdata/sf0.001"


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_mix(rows):
    """(doc_id, words before it in its source, words, words of its source, target, schedule) of all rows, by loops."""
    size = {i: len(WORD.findall(t or "")) for i, (t, _) in rows.items()}
    names = sorted({s for _, s in rows.values()}, key=lambda s: (s is None, s))
    total = {s: sum(size[i] for i, (_, x) in rows.items() if x == s) for s in names}
    weight = {s: mixing.WEIGHTS[k % len(mixing.WEIGHTS)] for k, s in enumerate(names)}
    left, open_, target = mixing.SHARE * sum(total.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > mixing.CAP * total[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: mixing.CAP * total[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    for k, s in enumerate(names):
        before = 0
        for i in sorted((i for i, (_, x) in rows.items() if x == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest()):
            yield i, before, size[i], total[s], round(target[s], 6), mixing.CURRICULUM[k % len(mixing.WEIGHTS) % len(mixing.CURRICULUM)]
            before += size[i]


def brute_copies(rows):
    made = {i: sum(2 * (e * total + before) + n < 2 * target for e in range(mixing.CAP)) for i, before, n, total, target, _ in brute_mix(rows)}
    return {i: n for i, n in made.items() if n}


def brute_positions(rows):
    """Training time of each copy: the integral of the schedule, inverted by bisection."""

    def integral(schedule, t):
        out = 0.0
        for (t0, w0), (t1, w1) in zip(schedule[:-1], schedule[1:]):
            if t > t0:
                x = min(t, t1) - t0
                out += w0 * x + (w1 - w0) / (t1 - t0) * x * x / 2
        return out

    made = {}
    for i, before, n, total, target, schedule in brute_mix(rows):
        for e in range(mixing.CAP):
            if 2 * (e * total + before) + n < 2 * target:
                u, low, high = min(1.0, (before + e * total + n / 2) / target), 0.0, 1.0
                for _ in range(60):
                    mid = (low + high) / 2
                    low, high = (mid, high) if integral(schedule, mid) < u * integral(schedule, 1.0) else (low, mid)
                made.setdefault(i, []).append(low)
    return {i: sorted(v) for i, v in made.items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    table = docs.select("doc_id", "text", "source").toArrow()
    good = model.score(quality.statistics(table.column(1))) >= 0.5
    rows = {i: (t, s) for (i, t, s), fine in zip(zip(*(c.to_pylist() for c in table.columns)), good) if fine}
    groups = simhash.brute_force([(i, t) for i, (t, _) in rows.items()])
    rows = {i: v for i, v in rows.items() if groups[i][1] == i}
    marks = {i: decontamination.brute_force(t, items) for i, (t, _) in rows.items()}
    rows = {i: v for i, v in rows.items() if not (marks[i][1] and 20 * marks[i][1] >= marks[i][0])}

    made = corpus_pipeline.run(spark, SF)
    assert made.columns[: len(docs.columns)] == docs.columns
    copies = {r.doc_id: r["count"] for r in made.groupBy("doc_id").count().collect()}
    assert set(copies) <= set(rows) and max(copies.values()) <= mixing.CAP
    assert copies == brute_copies(rows)
    # read in order of their places, rows follow the curriculum
    at = brute_positions(rows)
    order = [at[r.doc_id].pop(0) for r in made.orderBy("shard_place").select("doc_id").collect()]
    assert all(x <= y + 1e-9 for x, y in zip(order, order[1:])) and not any(at.values())
    # all columns of a row are those of its document
    assert made.select(docs.columns).distinct().join(docs, docs.columns).count() == len(copies)


def test_a_failed_run_goes_on(spark, tmp_path, monkeypatch):
    calls = []

    def stage(name, broken=False):
        def do(spark, docs, sf_dir):
            calls.append(name)
            if broken and calls.count(name) == 1:
                raise ValueError("lost")
            return docs
        return name, do

    spark.createDataFrame([(1, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b", True), stage("c")])
    with pytest.raises(RuntimeError) as told:
        corpus_pipeline.run(spark, str(tmp_path))
    folder = str(told.value).split("'")[1]
    assert corpus_pipeline.run(spark, str(tmp_path), folder).count() == 1 and calls == ["a", "b", "b", "c"]
    assert not os.path.exists(f"{folder.removeprefix('file://')}/a") and os.path.exists(f"{folder.removeprefix('file://')}/c")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_runs_at_once_have_stores_of_their_own(spark):
    """Two runs in one driver end with a store each, whose manifest lists the files that the rows are read from."""
    root = corpus_pipeline.common.checkpoint_dir(spark)
    folders = [f"{root}/pipeline-at-once-{i}" for i in range(2)]
    with ThreadPoolExecutor(2) as pool:
        made = list(pool.map(lambda f: corpus_pipeline.run(spark, SF, f), folders))
    rows = [sorted((r.doc_id, r.shard_place) for r in m.select("doc_id", "shard_place").collect()) for m in made]
    assert rows[0] == rows[1] and rows[0]
    for folder, m in zip(folders, made):
        store = sharding.ShardStore(spark, f"{folder}/sharding", ordered=True)
        listed = store.manifest().collect()
        assert sum(r["rows"] for r in listed) == len(rows[0]) and {r.path.removeprefix("file:") for r in listed} == {unquote(f).removeprefix("file://") for f in m.inputFiles()}
        assert sorted((r.doc_id, r.shard_place) for r in store.read().select("doc_id", "shard_place").collect()) == rows[0]
        again = corpus_pipeline.run(spark, SF, folder)  # finished: read from the store
        assert again.count() == len(rows[0]) and store.manifest().collect() == listed
