"""Registered queries without SQL, on the smallest tables, against loops that share no code with them but the models."""

import hashlib
import io
import math
import os
import re
import zlib

import numpy as np
import pytest

from textquarry.llm import language_id, licenses, quality, registry, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_language_id(spark, docs, texts):
    model = language_id.fit(docs)

    def scores(text):
        letters = [b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode()]
        total, n = np.zeros(len(model.langs)), 0
        for size, factor in ((2, 2654435761), (3, 2246822519), (4, 3266489917)):
            for k in range(len(letters) - size + 1):
                value = sum(b << 8 * j for j, b in enumerate(letters[k : k + size]))
                total += model.scores[((value * factor & 0xFFFFFFFF) ^ value >> 15) * 2654435769 % (1 << 32) >> 16]
                n += 1
        z = (total / max(1, n) + model.bias) / model.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    got = {r.doc_id: r for r in registry.QUERIES["op2_language_id"](spark, SF).collect()}
    assert set(got) == set(texts)
    right = []
    for i, text in texts.items():
        assert got[i].held_out == held_out(i)
        if text is None or not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        p = scores(text)
        assert got[i].lang_pred == model.langs[int(p.argmax())] and math.isclose(got[i].score, p.max(), abs_tol=1e-6)
        assert got[i].accepted == (got[i].score >= model.threshold)
    for r in docs.where("lang is not null").collect():
        if held_out(r.doc_id) and got[r.doc_id].lang_pred != "und":
            right.append(got[r.doc_id].lang_pred == r.lang)
    assert sum(right) > 0.9 * len(right)


def area_means(plane, height, width):
    """Means over the areas of a grid, pixel by pixel, each with the share of it that lies inside."""
    def shares(n, k, parts):
        low, high = n * k / parts, n * (k + 1) / parts
        return [(x, min(high, x + 1) - max(low, x)) for x in range(int(low), min(n, math.ceil(high)))]

    rows, columns = len(plane), len(plane[0])
    across = [[sum(line[x] * f for x, f in shares(columns, k, width)) for k in range(width)] for line in plane]
    area = rows / height * columns / width
    return [[sum(across[y][k] * f for y, f in shares(rows, j, height)) / area for k in range(width)] for j in range(height)]


def test_media(spark, texts):
    got = {r.doc_id: r for r in registry.QUERIES["op5_media"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        data = (text or "").encode()
        payload = data + b"\xff" * (576 * max(1, -(-len(data) // 576)) - len(data))
        stored = b"P6\n192 %d\n255\n" % (len(payload) // 576) + payload
        plane = [[(299 * payload[p] + 587 * payload[p + 1] + 114 * payload[p + 2]) // 1000 for p in range(y, y + 576, 3)] for y in range(0, len(payload), 576)]
        small = area_means(plane, 8, 9)
        bits = "".join("1" if round(row[k + 1], 6) > round(row[k], 6) else "0" for row in small for k in range(8))
        tile = io.BytesIO()
        np.save(tile, np.round(np.array(area_means(plane, 16, 16))).astype(np.uint8))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest())
        assert r.feature == f"{int(bits, 2):016x}" and r.tile_sha256 == hashlib.sha256(tile.getvalue()).hexdigest()


def test_quality(spark, docs, texts):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs, labels)
    table = docs.select("doc_id", "text").toArrow()
    x = dict(zip(table.column(0).to_pylist(), quality.statistics(table.column(1).combine_chunks())))
    place = {name: k for k, name in enumerate(quality.FEATURES)}
    for i, text in texts.items():
        data, words = (text or "").encode(), re.findall(r"[^\x20\x09-\x0D]+", text or "")
        share = [data.count(b) / len(data) for b in set(data)]
        plain = {
            "log_bytes": math.log1p(len(data)), "entropy": -sum(p * math.log2(p) for p in share), "log_words": math.log1p(len(words)),
            "distinct_words": len({w.encode().lower() for w in words}) / max(1, len(words)), "digit": sum(48 <= b < 58 for b in data) / max(1, len(data)),
            "log_lines": math.log1p(len([z for z in (text or "").split("\n") if z])),
        }
        assert all(math.isclose(x[i][place[name]], value, abs_tol=1e-9) for name, value in plain.items())

    def walk(v):
        total = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if v[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        return 1 / (1 + math.exp(-total))

    got = {r.doc_id: r for r in registry.QUERIES["op10_quality"](spark, SF).collect()}
    assert set(got) == set(texts)
    for i, v in x.items():
        assert math.isclose(got[i].score, walk(v), abs_tol=1e-9) and got[i].predicted == (got[i].score >= 0.5) and got[i].held_out == held_out(i)
    truth = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and held_out(r.doc_id) and r.doc_id in got}
    assert sum(got[i].predicted == q for i, q in truth.items()) > 0.9 * len(truth)


def test_simhash(spark, texts):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in registry.QUERIES["op4_simhash"](spark, SF).collect()}
    assert got == simhash.brute_force(list(texts.items()))


def test_licenses(spark, texts):
    got = {r.doc_id: (r.n_matches, r.licenses, r.best_dice) for r in registry.QUERIES["op6_licenses"](spark, SF).collect()}
    want = {i: licenses.brute_force(t) for i, t in texts.items()}
    assert got == {i: (len(m), ",".join(sorted({x[2] for x in m})), max((x[3] for x in m), default=0.0)) for i, m in want.items()}
    assert any(want.values())
