"""Small fixtures with nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import decontamination, induced, language_id, licenses, line_dedup, media, mixing, quality, repeats, sharding, simhash

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + r.choice([" ", " ", ", ", ".\n"]) for _ in range(n))


ROWS = [(i, prose(i, 60)) for i in range(12)] + [
    (20, prose(1, 60)), (21, prose(2, 60).replace("alpha", "omega", 1)), (22, prose(3, 30) + prose(4, 30)), (23, None), (24, ""), (25, " \n"),
    (26, "one"), (27, "-" * 300), (28, "x" + "-" * 200), (29, prose(5, 9000)), (30, "déjà vu " * 40), (31, "déjà vu " * 39),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "s", 7) for i, t in ROWS], "doc_id long, text string, lang string, h string, run long").repartition(3)


def test_decontamination(spark, docs):
    items = [(1, " ".join(prose(3, 60).split()[5:40])), (2, "One"), (3, None), (4, "no such words " * 9), (5, prose(4, 14)), (10, prose(4, 14)), (6, "")]
    table = spark.createDataFrame(items, "item_id long, text string")
    for chars in (8_000_000, 300):  # broadcast and joined
        made = decontamination.annotate(docs, table, block_chars=chars)
        got = {r.doc_id: (r.c.n_words, r.c.n_hit, r.c["items"]) for r in made.select("doc_id", F.col("contamination").alias("c")).collect()}
        assert got == {i: decontamination.brute_force(t, items) for i, t in ROWS}
    assert decontamination.remove_contaminated(docs, table).columns == docs.columns
    assert decontamination.annotate(docs, table.where("false")).where("contamination.n_hit > 0").count() == 0


def test_simhash(spark, docs):
    got = {r.doc_id: (f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == simhash.brute_force(ROWS)
    kept = simhash.keep_one(docs.unionAll(docs))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got.values()}) and kept.columns == docs.columns
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_simhash_postings_of_any_size():
    r = np.random.default_rng(1)
    fp = np.unique(np.uint64(0xABCD) ^ (np.uint64(1) << r.integers(32, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << r.integers(32, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << r.integers(32, 64, 900).astype(np.uint64)))
    free = [4, 5, 6, 7]
    labels = [simhash.common.components(fp.size, *f) for f in (simhash.links_by_pairs(fp), simhash.links_by_neighbours(fp, free, 1 << 12))]
    assert (labels[0] == labels[1]).all()


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i - 1) for i in range(1, 300)] + [(1001, 1000)], "a long, b long").repartition(7)
    assert {r.node: r.root for r in simhash.contract(edges).collect()} == {**{i: 0 for i in range(1, 300)}, 1001: 1000}


def test_repeats(spark, docs):
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans) // 2, bytes(r.kept)) for r in repeats.remove_repeats(docs).collect()}
    assert got == repeats.brute_force(ROWS)
    same = repeats.remove_repeats(spark.createDataFrame([(None, prose(1, 60)), (5, prose(1, 60)), (5, prose(1, 60))], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, len(r.kept)) for r in same)[0] == (0, 0) and len(same) == 3
    assert repeats.remove_repeats(docs.where("false")).count() == 0


@pytest.mark.parametrize("budget", [1 << 20, 40])
def test_induced_sorting(budget):
    for seed in range(40):
        r = np.random.default_rng(seed)
        text = np.append(np.repeat(r.integers(1, 4, 150), r.integers(1, 5, 150)), 0).astype(np.uint8)
        made = list(induced.scan_suffixes(text, 12, budget))
        at, raw = np.concatenate([m[0] for m in made]), bytes(text) + bytes(20)
        inner = at[at < text.size - 13].tolist()
        assert sorted(at.tolist()) == list(range(text.size))
        keys = [raw[a : a + 12] for a in inner]
        assert keys == sorted(keys, reverse=True)
        # prefixes tell equal neighbours from others, to the depth
        told = np.concatenate([m[1] for m in made])
        same = [raw[a : a + 12] == raw[b : b + 12] for a, b in zip(at[:-1], at[1:])]
        whole = [max(a, b) < text.size - 13 for a, b in zip(at[:-1], at[1:])]
        assert all(x == (n >= 12) for x, n, w in zip(same, told[1:], whole) if w)


def test_an_ordinary_shard_is_sorted_on_disk():
    r = np.random.default_rng(2)
    text = np.append(r.integers(1, 60, repeats.SHARD_BYTES // 2), 0).astype(np.uint8)
    told = {}
    n = sum(at.size for at, _ in induced.scan_suffixes(text, repeats.WIDTH, told=told))
    assert n == text.size and told["spilled"] > text.size // 2
    start = np.arange(0, text.size - 1, 82)
    text[start[1:] - 1] = 0
    count = np.diff(np.append(start, text.size)) - 50
    ids = r.integers(0, 1000, start.size)
    text[82 * 700 : 82 * 700 + 81] = text[82 * 20 : 82 * 20 + 81]
    masks = repeats.shard_masks(text, start, count, ids, 50)
    later = 700 if ids[700] > ids[20] else 20
    assert masks[later] == (1 << 32) - 1 if ids[700] != ids[20] else not masks.any()
    assert np.count_nonzero(masks) == (ids[700] != ids[20])


def test_line_dedup(spark, docs):
    got = {r.doc_id: r.kept for r in line_dedup.dedup(docs).collect()}
    assert got == line_dedup.brute_force(ROWS)
    assert line_dedup.dedup(docs.where("false")).count() == 0


def test_licenses(docs):
    text = "Some words.\nReleased under the MIT license\n\nThis work is licensed under the GNU General Public License, version 3.\nmore"
    made = licenses.scan(docs.limit(2).withColumn("text", F.when(F.col("doc_id") >= 0, F.lit(text)))).first().license_matches
    assert [(m.start, m.end, m.license, m.dice) for m in made] == licenses.brute_force(text) and {m.license for m in made} == {"MIT", "GPL-3.0"}
    assert licenses.scan(docs).where("size(license_matches) > 0").count() == 0


def test_media(docs):
    r = np.random.default_rng(3)
    image = r.integers(0, 256, (7, 5, 3)).astype(np.uint8)
    assert (media.decode(b"P6 # note\n5 7\n255\n" + image.tobytes()) == image).all()
    assert (media.decode(b"P3 5 7 255\n" + b" ".join(b"%d" % v for v in image.ravel())) == image).all()
    assert (media.decode(b"P1\n3 1\n1 0 1") == [[0, 255, 0]]).all() and (media.decode(b"P4\n3 1\n\xa0") == [[0, 255, 0]]).all()
    wide = r.integers(0, 60000, (3, 4)).astype(">u2")
    assert (media.decode(b"P5\n4 3\n65535\n" + wide.tobytes()) == wide).all()
    rows = b"".join(image[y, :, ::-1].tobytes() + b"\0" for y in range(6, -1, -1))
    bmp = b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (5).to_bytes(4, "little") + (7).to_bytes(4, "little") + b"\1\0\x18\0" + bytes(24) + rows
    assert (media.decode(bmp) == image).all()
    small = media.area_resize(media.grey(image), 7, 5)
    assert np.allclose(small, media.grey(image))
    assert np.isclose(media.area_resize(media.grey(image), 1, 1)[0, 0], media.grey(image).mean())
    import io

    tile, dhash = media.tile(image, 4)
    assert np.load(io.BytesIO(tile)).shape == (4, 4) and len(dhash) == 16
    found = media.media_columns(docs.select("doc_id", F.encode("text", "UTF-8").alias("m")), "m")
    assert found.where("media_error is null").count() == 1 and found.count() == len(ROWS)
    n, padded, digest, *_ = media.store_payload("é".encode())
    assert (n, padded, digest) == (2, 576, hashlib.sha256("é".encode() + b"\xff" * 574).hexdigest())


def test_mixing(spark, docs):
    sources = docs.withColumn("source", F.when(F.col("doc_id") < 15, F.lit("hot")).when(F.col("doc_id") < 28, F.lit("b")))
    made = mixing.mix(sources).collect()
    total = sum(r.size for r in made)
    per = {}
    for r in made:
        per.setdefault(r.row.source, []).append(r)
        assert 0 <= r.copies <= 2
    targets = {s: rows[0].target for s, rows in per.items()}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-3
    for rows in per.values():
        assert abs(sum(r.size * r.copies for r in rows) - rows[0].target) <= max(r.size for r in rows)
        assert rows[0].target <= 2 * rows[0].source_size + 1e-6
    again = mixing.mixed_rows(sources)
    assert again.columns == sources.columns and again.count() == sum(r.copies for r in made)
    assert mixing.mix(sources.where("false")).count() == 0


def test_sharding(spark, docs, tmp_path):
    out = sharding.shard_table(docs, 20_000)
    assert sorted(map(repr, out.drop("arrival").collect())) == sorted(map(repr, docs.collect()))
    assert sharding.shard_table(docs.where("false")).count() == 0
    store = sharding.ShardStore(spark, str(tmp_path / "store"), 1 << 20)
    for k in range(3):
        store.append(docs.where(F.col("doc_id") % 3 == k))
    before = store.manifest().count()
    assert store.compact() == 4 and store.manifest().count() < before and store.read().count() == len(ROWS)
    assert store.read(1).count() == docs.where("doc_id % 3 = 0").count()
    with pytest.raises(sharding.VersionConflict):
        store.commit(store.manifest(), 4)
    store.expire()
    assert store.read().count() == len(ROWS)


def test_of_two_writers_one_commits(spark, docs, tmp_path):
    root = str(tmp_path / "store")
    one, two = (sharding.ShardStore(spark, root) for _ in range(2))
    one.append(docs.limit(3))
    shards, version = one.manifest(), one.version() + 1
    one._claim(version, "first")  # both have seen that the version is free
    with pytest.raises(sharding.VersionConflict):
        two._claim(version, "second")
    with open(one._marker(version)) as f:
        assert f.read() == "first"
    with pytest.raises(sharding.VersionConflict):
        two.commit(shards, version)
    store = sharding.ShardStore(spark, str(tmp_path / "other"))
    store.append(docs)
    late, seen = sharding.ShardStore(spark, store.root), []
    late.version = lambda: seen.append(1) or (0 if len(seen) == 1 else store.version())  # it looked before the first commit
    assert late.append(docs) == 2 and store.read().count() == 2 * len(ROWS) and len(seen) == 2


def test_ordered_shards_keep_the_order(spark, tmp_path):
    rows = spark.range(5000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("place")).repartitionByRange(23, "id").sortWithinPartitions("id")
    rows.write.parquet(str(tmp_path / "rows"))
    made = sharding.shard_table(spark.read.parquet(str(tmp_path / "rows")), 150_000, place_name="place", doc_id="id", root=str(tmp_path / "store"))
    assert made.columns == ["id", "place", "arrival", "place_"] and {r.arrival for r in made.collect()} == {0, 1, 2, 3, 4}
    assert [r.id for r in made.orderBy("place_").collect()] == list(range(5000))
    store = sharding.ShardStore(spark, str(tmp_path / "store"), 150_000, ordered=True)
    shards = store.manifest().orderBy("first").collect()
    assert 1 < len(shards) < 23
    ids = [[r.id for r in spark.read.parquet(s.path).select("row.id").collect()] for s in shards]
    assert sum(ids, []) == list(range(5000))


def test_language(spark):
    r = random.Random(0)
    text = lambda letters: " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(40))
    rows = [(i, text("abcdefg") if i % 2 else text("éèqrstuv"), "xx" if i % 2 else "yy") for i in range(120)] + [(200, None, "xx"), (201, "123 !", "yy"), (202, text("abcd"), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.predict(df, language_id.fit(df)).collect()
    assert all(x.lang_pred == ("und" if x.doc_id in (200, 201) else "xx" if x.doc_id == 202 else x.lang) and 0 <= x.score <= 1 for x in got)
    assert {x.lang_pred for x in language_id.predict(df, language_id.fit(df.where("false"))).collect()} == {"und"}


def test_quality(spark, docs):
    rows = [(i, prose(i, 80) if i % 2 else "BUY NOW!!! " * 30, i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, q long")
    labels = df.select("doc_id", F.col("q").alias("quality"))
    got = quality.score(df, quality.fit(df, labels)).collect()
    assert all((x.score >= 0.5) == (x.q == 1) for x in got)
    assert quality.keep_good(docs, labels.where("false")).columns == docs.columns
