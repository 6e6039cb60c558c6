"""Queries over vectors."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..operators import dense
from ..operators.numbering import numbered
from .base import table

Q: dict = {}


def vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"), "label")


def queries(s, d):
    return vectors(s, d).where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "v")


DOT = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_ALL = f"""SELECT q.vec_id AS query_id, c.vec_id AS doc_id, round({DOT('q.embedding', 'c.embedding')}, {{}}) AS score
FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0"""
Q["cosine_all_pairs"] = (lambda s, d: dense.scores(queries(s, d), vectors(s, d)), _ALL.format(6))
Q["topk_dense"] = (lambda s, d: dense.search(queries(s, d), vectors(s, d), 10), f"""SELECT *
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({_ALL.format(6)}))
WHERE rank <= 10""")
Q["l2_normalize"] = (
    lambda s, d: vectors(s, d).select("doc_id", vx.l2_normalize(F.transform("v", lambda x: x * 3)).alias("u")).select("doc_id", F.round(vx.dot(F.col("u"), F.col("u")), 6).alias("norm2"), F.round(F.col("u")[0], 5).alias("first")),
    f"""SELECT vec_id AS doc_id, round({DOT('u', 'u')}, 6) AS norm2, round(u[1], 5) AS first
FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt({DOT('embedding', 'embedding')})) AS u
FROM embeddings)""")
Q["mean_pool"] = (
    lambda s, d: vectors(s, d).select("label", F.posexplode("v").alias("dim", "x")).groupBy("label", "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean")).withColumn("dim", F.col("dim").cast("long")),
    """SELECT label, i::BIGINT - 1 AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean
FROM embeddings, unnest(range(1, 65)) AS r(i) GROUP BY label, i""")
BATCH = 32


def batches(s, d, size: int = BATCH):
    """(batch, query_id, label, q, c) of whole batches in id order: a vector of even id and the odd one after it; a
    last partial batch is dropped. Places come from ids, so nothing is sorted globally."""
    v = vectors(s, d)
    pairs = v.where("doc_id % 2 = 0").select(F.floor(F.col("doc_id") / 2).alias("i"), F.col("doc_id").alias("query_id"), "label", F.col("v").alias("q")).join(v.where("doc_id % 2 = 1").select(F.floor((F.col("doc_id") - 1) / 2).alias("i"), F.col("v").alias("c")), "i")
    made = pairs.withColumn("batch", F.floor(F.col("i") / size))
    full = F.count("*").over(Window.partitionBy("batch")) == size
    return made.withColumn("full", full).where("full").drop("full", "i")


def in_batch(b, temperature: float = 0.07):
    """All pairs inside each batch of b (batch, query_id, label, q, c), with the mask of false negatives: same label, not
    the own pair. The pairs of a batch are its size squared, whatever the table's size."""
    if temperature <= 0:
        raise ValueError("temperature must be above 0")
    other = b.select("batch", F.col("query_id").alias("other_id"), F.col("label").alias("other_label"), F.col("c").alias("oc"))
    sim = b.join(other, "batch").select("batch", "query_id", "other_id", (F.col("label") == F.col("other_label")).alias("same"), (vx.dot(F.col("q"), F.col("oc")) / temperature).alias("raw"))
    masked = F.col("same") & (F.col("query_id") != F.col("other_id"))
    return sim.select("batch", "query_id", "other_id", masked.alias("masked"), F.when(masked, F.lit(-1e4)).otherwise(F.col("raw")).alias("sim"))


def similarities(s, d, temperature: float = 0.07):
    return in_batch(batches(s, d), temperature)


def cross_entropy(sim, side: str, extra=None):
    """(batch, loss) of each row of a side: log-sum-exp, taken from the largest, of its similarities (and of those of
    `extra` (batch, side, sim), which hold no target) less the similarity of its own pair."""
    rows = sim.select("batch", F.col(side).alias("a"), "sim", (F.col("query_id") == F.col("other_id")).alias("own"))
    if extra is not None:
        rows = rows.unionByName(extra.select("batch", F.col(side).alias("a"), "sim", F.lit(False).alias("own")))
    top = rows.groupBy("batch", "a").agg(F.max("sim").alias("m"))
    spread = rows.join(top, ["batch", "a"]).groupBy("batch", "a", "m")
    loss = F.log(F.sum(F.exp(F.col("sim") - F.col("m")))) + F.col("m") - F.sum(F.when(F.col("own"), F.col("sim")).otherwise(0.0))
    return spread.agg(loss.alias("loss")).select("batch", "loss")


def symmetric_loss(sim, extra=None):
    """Mean of both directions' cross-entropy, by batch; hard negatives extend the queries' direction only."""
    both = cross_entropy(sim, "query_id", extra).unionAll(cross_entropy(sim, "other_id"))
    return both.groupBy("batch").agg(F.round(F.avg("loss"), 5).alias("loss"))


def infonce(s, d):
    return symmetric_loss(similarities(s, d))


HARD = 3


def hard_negatives(b, k: int = HARD):
    """(batch, query_id, n): k vectors for each query of a batch: those of the next k pairs in it, in a ring by id."""
    place = F.row_number().over(Window.partitionBy("batch").orderBy("query_id")) - 1
    size = F.count("*").over(Window.partitionBy("batch"))
    placed = b.select("batch", "query_id", "q", "c", place.alias("i"), size.alias("size"))
    wanted = placed.select("batch", "query_id", F.explode(F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: (F.col("i") + j) % F.col("size"))).alias("i"))
    return wanted.join(placed.select("batch", "i", F.col("q").alias("n")), ["batch", "i"]).select("batch", "query_id", "n")


def hard_loss(s, d, shared: bool = False, temperature: float = 0.07):
    """InfoNCE with hard negatives: each query's own, or (shared) those of all queries of its batch."""
    b = batches(s, d)
    hard = hard_negatives(b)
    asks = b.select("batch", "query_id", "q")
    met = asks.join(hard.drop("query_id"), "batch") if shared else asks.join(hard, ["batch", "query_id"])
    extra = met.select("batch", "query_id", (vx.dot(F.col("q"), F.col("n")) / temperature).alias("sim"))
    return symmetric_loss(in_batch(b, temperature), extra)


def inbatch_accuracy(s, d):
    sim = similarities(s, d).withColumn("sim", F.round("sim", 6))
    q = sim.groupBy("batch", "query_id").agg(F.max_by("other_id", F.struct("sim", (-F.col("other_id")).alias("o"))).alias("best")).groupBy("batch").agg(F.round(F.avg((F.col("best") == F.col("query_id")).cast("double")), 6).alias("forward"))
    c = sim.groupBy("batch", "other_id").agg(F.max_by("query_id", F.struct("sim", (-F.col("query_id")).alias("o"))).alias("best")).groupBy("batch").agg(F.round(F.avg((F.col("best") == F.col("other_id")).cast("double")), 6).alias("backward"))
    return q.join(c, "batch")


_B = f"""p AS (SELECT q.vec_id AS query_id, q.label, q.embedding AS q, c.embedding AS c, q.vec_id // 2 // {BATCH} AS batch
FROM embeddings q JOIN embeddings c ON c.vec_id = q.vec_id + 1 WHERE q.vec_id % 2 = 0), b AS (SELECT *
FROM (SELECT *, count(*) OVER (PARTITION BY batch) AS n FROM p) WHERE n = {BATCH})"""
_S = f"""WITH {_B}, raw AS (SELECT x.batch, x.query_id, y.query_id AS other_id, x.label = y.label
AND x.query_id != y.query_id AS masked, {DOT('x.q', 'y.c')} / 0.07::DOUBLE AS r FROM b x JOIN b y ON x.batch = y.batch),
s AS (SELECT batch, query_id, other_id, masked, CASE WHEN masked THEN -10000.0::DOUBLE ELSE r END AS sim FROM raw)"""
_LOSS = """SELECT batch, ln(sum(exp(sim - m))) + max(m) - sum(CASE WHEN query_id = other_id THEN sim ELSE 0 END) AS loss
FROM (SELECT *, max(sim) OVER (PARTITION BY batch, {0}) AS m FROM s) GROUP BY batch, {0}"""
Q["infonce_loss"] = (infonce, f"""{_S} SELECT batch, round(avg(loss), 5) AS loss FROM ({_LOSS.format('query_id')}
UNION ALL {_LOSS.format('other_id')}) GROUP BY batch""")
_HARD = f"""{_S}, pl AS (SELECT batch, query_id, q, row_number() OVER (PARTITION BY batch ORDER BY query_id) - 1 AS i FROM b),
hn AS (SELECT x.batch, x.query_id, y.q AS n FROM pl x, range(1, {HARD + 1}) AS r(j), pl y WHERE y.batch = x.batch AND y.i = (x.i + j) % {BATCH}),
ex AS (SELECT b.batch, b.query_id, {DOT('b.q', 'hn.n')} / 0.07::DOUBLE AS sim FROM b JOIN hn ON hn.batch = b.batch {{}}),
al AS (SELECT batch, query_id, sim, query_id = other_id AS own FROM s UNION ALL SELECT batch, query_id, sim, false FROM ex),
lf AS (SELECT batch, ln(sum(exp(sim - m))) + max(m) - sum(CASE WHEN own THEN sim ELSE 0 END) AS loss FROM (SELECT *, max(sim) OVER (PARTITION BY batch, query_id) AS m FROM al) GROUP BY batch, query_id)
SELECT batch, round(avg(loss), 5) AS loss FROM (SELECT * FROM lf UNION ALL {_LOSS.format('other_id')}) GROUP BY batch"""
Q["hard_negative_loss"] = (hard_loss, _HARD.format("AND hn.query_id = b.query_id"))
Q["shared_hard_negative_loss"] = (lambda s, d: hard_loss(s, d, shared=True), _HARD.format(""))
Q["inbatch_accuracy"] = (
    inbatch_accuracy,
    f"""{_S}, f AS (SELECT batch, query_id AS a, other_id AS b, row_number() OVER (PARTITION BY batch, query_id
ORDER BY round(sim, 6) DESC, other_id) AS r FROM s),
g AS (SELECT batch, other_id AS a, query_id AS b, row_number() OVER (PARTITION BY batch, other_id
ORDER BY round(sim, 6) DESC, query_id) AS r FROM s) SELECT x.batch, forward, backward
FROM (SELECT batch, round(avg((a = b)::INT::DOUBLE), 6) AS forward FROM f WHERE r = 1 GROUP BY batch) x
JOIN (SELECT batch, round(avg((a = b)::INT::DOUBLE), 6) AS backward FROM g WHERE r = 1 GROUP BY batch) y ON x.batch = y.batch""",
)
Q["false_negative_mask"] = (
    lambda s, d: similarities(s, d).where("masked").select("batch", "query_id", "other_id"),
    f"{_S} SELECT batch, query_id, other_id FROM s WHERE masked")
Q["batch_assign"] = (lambda s, d: batches(s, d).select("batch", "query_id"), f"WITH {_B} SELECT batch, query_id FROM b")


def _pca(s, d, k: int = 2):
    v = vectors(s, d).where("v is not null").select("doc_id", array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="p").fit(v), v


def pca_2d(s, d):
    """Centred coordinates on the first two principal components; each component's largest loading is positive."""
    model, v = _pca(s, d)
    loads = model.pc.toArray()
    sign = [1.0 if column[abs(column).argmax()] > 0 else -1.0 for column in loads.T]
    made = model.transform(v).select("doc_id", vector_to_array("p").alias("p"))
    mean = made.agg(F.avg(F.col("p")[0]).alias("mx"), F.avg(F.col("p")[1]).alias("my"))
    return made.crossJoin(F.broadcast(mean)).select("doc_id", (sign[0] * (F.col("p")[0] - F.col("mx"))).alias("x"), (sign[1] * (F.col("p")[1] - F.col("my"))).alias("y"))


Q["pca_2d"] = (pca_2d, None)


def pca_variance(s, d, k: int = 2):
    """(component, share) of the variance that the first k principal components explain."""
    shares = [float(x) for x in _pca(s, d, k)[0].explainedVariance.toArray()]
    return s.createDataFrame(list(enumerate(shares, 1)), "component long, share double")


Q["pca_variance"] = (pca_variance, None)
POSITIONS = 8


def masked(s, d, size: int = POSITIONS):
    """(seq, states, mask): all vectors, cut into sequences of `size` consecutive ids; places without a vector have zeros that
    the mask tells."""
    seq, at = F.floor(F.col("doc_id") / size).cast("long"), F.pmod("doc_id", F.lit(size)).cast("int")
    rows = vectors(s, d).where("v is not null").groupBy(seq.alias("seq")).agg(F.map_from_entries(F.collect_list(F.struct(at.alias("i"), "v"))).alias("r"))
    place = F.sequence(F.lit(0), F.lit(size - 1))
    zero = F.transform(F.get(F.map_values("r"), F.lit(0)), lambda x: F.lit(0.0).cast("float"))
    states = F.transform(place, lambda i: F.coalesce(F.try_element_at("r", i), zero))
    return rows.select("seq", states.alias("states"), F.transform(place, lambda i: F.map_contains_key("r", i).cast("int")).alias("mask"))


def _pooled(df, v):
    return df.select("seq", F.posexplode(v).alias("dim", "x")).select("seq", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


Q["masked_mean_pool"] = (
    lambda s, d: _pooled(masked(s, d), vx.masked_mean(F.col("states"), F.col("mask"))),
    f"""SELECT vec_id // {POSITIONS} AS seq, i::BIGINT - 1 AS dim, round(avg(embedding[i]::DOUBLE), 6) AS x
FROM embeddings, unnest(range(1, 65)) AS r(i) GROUP BY seq, i""",
)
Q["first_position_pool"] = (
    lambda s, d: _pooled(masked(s, d), F.transform(vx.first_position(F.col("states")), lambda x: x.cast("double"))),
    f"""SELECT vec_id // {POSITIONS} AS seq, i::BIGINT - 1 AS dim, round(coalesce(max(CASE WHEN vec_id % {POSITIONS} = 0 THEN embedding[i]::DOUBLE END), 0), 6) AS x
FROM embeddings, unnest(range(1, 65)) AS r(i) GROUP BY seq, i""",
)


def lr_schedule(s, d, peak: float = 5e-4, warm: float = 0.1):
    """(batch, step, rate) of the batches of the table's pairs: the rate climbs over the first tenth of them and falls along
    half a cosine to 0 behind the last. A batch's step is its place among the batches that are full."""
    full = batches(s, d).select("batch").distinct()
    steps = numbered(full, "batch", "step")
    total = F.lit(full.count()).cast("double")
    step, warmup = F.col("step").cast("double"), F.ceil(total * warm)
    rate = F.when(step < warmup, peak * step / warmup).otherwise(peak * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * (step - warmup) / (total - warmup))))
    return steps.select("batch", "step", F.round(rate, 9).alias("rate"))


Q["lr_schedule"] = (
    lr_schedule,
    f"""WITH {_B}, st AS (SELECT batch, row_number() OVER (ORDER BY batch) - 1 AS step, count(*) OVER ()::DOUBLE AS n FROM (SELECT DISTINCT batch FROM b)),
w AS (SELECT *, ceil(n * 0.1::DOUBLE) AS w FROM st)
SELECT batch, step, round(CASE WHEN step < w THEN 0.0005::DOUBLE * step / w ELSE 0.0005::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * (step - w) / (n - w))) END, 9) AS rate FROM w""",
)
