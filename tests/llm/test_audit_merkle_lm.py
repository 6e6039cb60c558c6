"""Filter audit, Merkle manifest and language-model scores against plain loops, over odd rows and the smallest tables."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from textquarry.llm import common, filter_audit, lattice, lm_scoring, merkle

SF = "/root/testdata/sf0.001"
GAP = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `file` string, place string, `a.b` string, mask string, `hash` string, `group` string, word string"
TAIL = ("f", "p", "d", "m", "h", "g", "w")
LONG = " ".join(f"word{i}" for i in range(30_000))
ROWS = [
    (1, "Plain text.\nof words", "en", "s", 1, *TAIL), (2, "Plain text.\nof words", "en", "s", 2, *TAIL), (3, "SHOUTING A LOT", "de", None, 3, *TAIL),
    (4, None, None, "s", None, *TAIL), (5, "", "", "t", 0, *TAIL), (6, LONG, "en", "s", 9, *TAIL), (6, LONG, "en", "s", 9, *TAIL), (7, " ".join(["same"] * 300), "en", "s", 7, *TAIL),
    (None, "no id\n", "en", "s", 1, *TAIL), (None, "no id\n", "en", None, 1, *TAIL), (8, "a # sign", "fr", "été", 1, *TAIL), (9, "\n\n\x0b", "fr", "\U0001f600", 1, *TAIL),
    (10, "Été à la mer\n", "fr", "s", 1, *TAIL), (11, "a # sign", "fr", "s", 1, *TAIL), (11, "other text of that id", "fr", "s", 1, *TAIL),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (None, 1, 1), (8, 0, 1), (11, 1, 0), (99, 1, 1)]


@pytest.fixture(scope="module", params=["odd", "empty", "small"])
def folder(spark, request, tmp_path_factory):
    if request.param == "small":
        if not os.path.isdir(SF):
            pytest.skip("no test tables")
        return SF
    made = str(tmp_path_factory.mktemp(request.param))
    rows = ROWS if request.param == "odd" else []
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{made}/documents.parquet")
    spark.createDataFrame(LABELS if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{made}/labels.parquet")
    return made


def table(spark, folder, name="documents"):
    return [r.asDict() for r in spark.read.parquet(f"{folder}/{name}.parquet").collect()]


def test_filter_audit(spark, folder):
    rows, labels = table(spark, folder), table(spark, folder, "labels")
    good, toxic = ({r["doc_id"] for r in labels if r["doc_id"] is not None and r[c] == 1} for c in ("quality", "toxic"))
    first = {}
    for r in rows:
        if r["doc_id"] is not None:
            first[r["text"] or ""] = min(r["doc_id"], first.get(r["text"] or "", r["doc_id"]))
    fails = []
    for r in rows:
        t = r["text"] or ""
        words = GAP.findall(t)
        own = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": bool(set(t) & set("#$%&*|")), "E": r["doc_id"] is not None and r["doc_id"] > first[t]}
        fails.append((r["lang"] or "", {k for k, v in own.items() if v}, r["doc_id"] in good, r["doc_id"] in toxic))
    want, shapley = {}, Counter()
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                removed = [f for f in left if letter in f[1]]
                left = [f for f in left if letter not in f[1]]
                redundant = sum(letter in f[1] and bool(f[1] & set(order[: step - 1])) for f in mine)
                want[part, order, step] = [len(left), len(removed), redundant, sum(f[1] == {letter} for f in mine), sum(f[2] for f in removed), sum(f[3] for f in removed)]
                shapley[part, letter] += len(removed)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in filter_audit.op11_filter_audit(spark, folder).collect()}
    assert got == {k: [*v, shapley[k[0], k[1][k[2] - 1]]] for k, v in want.items()}


def test_merkle(spark, folder):
    h = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: h(*(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars")), field(t))

    def climb(nodes):
        """The root of nodes, and for each the (before, after) siblings on its way."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, i in enumerate(at):
                low = i - i % 3
                ways[k].append(("".join(nodes[low:i]), "".join(nodes[i + 1 : low + 3])))
            nodes, at = [h(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)], [i // 3 for i in at]
        return nodes[0], ways

    groups = defaultdict(list)
    for r in table(spark, folder):
        groups[r["source"]].append((r, leaf(r, r["text"])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
    trees = {g: climb([x[1] for x in groups[g]]) for g in names}
    want = Counter()
    root, tops = climb([trees[g][0] for g in names]) if names else (None, [])
    for g, top in zip(names, tops):
        for (r, own), way in zip(groups[g], trees[g][1]):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            folded = leaf(r, r["text"] and r["text"].replace("\n", "")) if tampered else own
            for before, after in way + top:
                folded = h(before, folded, after)
            want[r["doc_id"], own, trees[g][0], root, h(*(a + b for a, b in way + top)), folded, folded == root] += 1
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert Counter(tuple(r[c] for c in names) for r in merkle.op13_merkle(spark, folder).collect()) == want


@pytest.mark.skipif(not os.path.isfile(lm_scoring.VOCABULARY), reason="no vocabulary")
def test_language_model(spark, folder):
    rows = table(spark, folder)
    tokens = [[w.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) for w in GAP.findall(r["text"] or "")] for r in rows]
    held = [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows]
    learned = [(r["lang"], t) for r, t, out in zip(rows, tokens, held) if not out]
    c = Counter(w for _, t in learned for w in t)
    n, v = sum(c.values()) + len(learned), len(c) + bool(learned)
    by_lang = Counter(x for x, _ in learned if x is not None)
    classes = sorted(by_lang, key=lambda x: (-by_lang[x], x))[: lm_scoring.MAX_CLASSES]
    of = lambda x: classes.index(x) if x in classes else len(classes)
    counts, ends = [Counter() for _ in range(len(classes) + 1)], Counter(of(x) for x, _ in learned)
    for x, t in learned:
        counts[of(x)].update(t)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    with common.scratch(spark) as scratch:
        pieces = lm_scoring.fit(docs.where(~lm_scoring.held_out("doc_id")), f"{scratch}/words").pieces
    ways = {}  # the pieces of a state, by bytes
    stack = [(0, b"")]
    after = defaultdict(list)
    for k, child in zip(pieces.edge.tolist(), pieces.child.tolist()):
        after[k // 256].append((k % 256, child))
    while stack:
        state, name = stack.pop()
        if pieces.ends[state] >= 0:
            ways[name] = math.exp(pieces.weight[pieces.ends[state]])
        stack += [(child, name + bytes([b])) for b, child in after[state]]
    longest = max(map(len, ways))

    def marginal(word):
        data = lattice.BEGIN + word.encode()
        alpha = [1.0] + [0.0] * len(data)
        for j in range(1, len(data) + 1):
            alpha[j] = alpha[j - 1] * math.exp(pieces.weight[data[j - 1]]) + sum(alpha[i] * ways.get(data[i:j], 0.0) for i in range(max(0, j - longest), j))
        return math.log(alpha[-1])

    subs = {}

    def log_prob(k, word):
        if word not in subs:
            subs[word] = pieces.weight[256] if word is None else marginal(word)
        count, own, types = (len(learned), ends[k], len(counts[k]) + (ends[k] > 0)) if word is None else (c[word], counts[k][word], len(counts[k]) + (ends[k] > 0))
        everywhere = (count + max(1, v) * math.exp(subs[word])) / (n + max(1, v))
        return math.log((own + max(1, types) * everywhere) / (sum(counts[k].values()) + ends[k] + max(1, types)))

    got = defaultdict(list)
    for r in lm_scoring.op12_lm_scoring(spark, folder).collect():
        got[r.doc_id].append(r)
    assert Counter({i: len(x) for i, x in got.items()}) == Counter(r["doc_id"] for r in rows)
    of_rows = defaultdict(list)
    for r, t, out in zip(rows, tokens, held):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t) + math.log10((len(learned) + 1) / (n + v + 1))
        if len(t) < 3000:
            logs = [math.log(ends[k] / len(learned)) + sum(m * log_prob(k, w) for w, m in Counter(t).items()) + log_prob(k, None) for k in range(len(classes) + 1) if ends[k]]
            score = (max(logs) + math.log(sum(math.exp(x - max(logs)) for x in logs))) / math.log(10)
        else:
            score = None
        of_rows[r["doc_id"]].append((out, len(t) + 1, sum(c[w] > 0 for w in t) + bool(learned), n, base, score))
    for i, wanted in of_rows.items():
        for want, r in zip(sorted(wanted, key=lambda x: x[1:5]), sorted(got[i], key=lambda r: (r.n_tokens, r.n_known, r.train_tokens, r.base_score))):
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
            assert math.isclose(r.base_score, want[4], rel_tol=1e-9) and r.score < 0
            assert want[5] is None or math.isclose(r.score, want[5], abs_tol=1e-6 * r.n_tokens + 1e-6)


def test_lattice_sums_over_all_segmentations():
    pieces = lattice.trie([b"ab", b"abc", b"c", "é".encode()], np.log(np.full(261, 1 / 261)))
    p = 1 / 261
    words = [b"a", b"abc", b"abcab", "é".encode()]
    # by hand: abc is a|b|c twice over (c is a byte and a piece), ab|c twice, and abc
    want = [p, 2 * p**3 + 2 * p**2 + p, None, p**2 + p]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    got = np.exp(lattice.forward(pieces, np.frombuffer(b"".join(words), np.uint8), offsets)[0])
    want[2] = want[1] * (p**2 + p)
    assert np.allclose(got, want, rtol=1e-12)
    counts, total = lattice.expected(pieces, np.frombuffer(b"".join(words), np.uint8), offsets, np.array([1.0, 2.0, 1.0, 1.0]))
    assert math.isclose(total, math.log(want[0]) + 2 * math.log(want[1]) + math.log(want[2]) + math.log(want[3]), rel_tol=1e-12)
    # the pieces of every path cover all bytes of the words
    length = np.array([1] * 256 + [0] + [2, 3, 1, 2])
    assert math.isclose(counts @ length, 1 + 2 * 3 + 5 + 2, rel_tol=1e-9)
