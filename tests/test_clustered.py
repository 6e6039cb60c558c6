"""Cases that the given tables don't hold, where a shortened query would lose rows."""

import numpy as np

from textquarry.plans import dense, training


def test_dense_negatives_of_clustered_labels(spark, tmp_path):
    r = np.random.default_rng(1)
    v = np.repeat(np.eye(2, 64), 60, axis=0) + r.normal(0, 0.01, (120, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = [i // 60 for i in range(120)]
    rows = [(i, v[i].astype(np.float32).tolist(), label[i]) for i in range(120)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for row in training.mine_dense(spark, str(tmp_path)).orderBy("query_id", "neg_pos").collect():
        got.setdefault(row.query_id, []).append(row.doc_id)
    f = v.astype(np.float32).astype(np.float64)
    want = {q: sorted((d for d in range(120) if label[d] != label[q]), key=lambda d: (-round(float(f[q] @ f[d]), 6), d))[:7] for q in range(0, 120, 20)}
    assert got == want


def test_principal_components(spark, tmp_path):
    r = np.random.default_rng(4)
    v = (r.normal(size=(300, 6)) * [5, 3, 1, 0.5, 0.2, 0.1]) @ np.linalg.qr(r.normal(size=(6, 6)))[0]
    spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    values, vectors = np.linalg.eigh(np.cov(v.T))
    top = vectors[:, ::-1][:, :2]
    top *= np.where(top[np.abs(top).argmax(axis=0), [0, 1]] > 0, 1, -1)
    want = (v - v.mean(axis=0)) @ top
    got = np.array([(x.x, x.y) for x in dense.pca_2d(spark, str(tmp_path)).orderBy("doc_id").collect()])
    assert np.allclose(got, want, atol=1e-8)
    shares = [x.share for x in dense.pca_variance(spark, str(tmp_path)).orderBy("component").collect()]
    assert np.allclose(shares, values[::-1][:2] / values.sum(), atol=1e-9)
