"""Cases that a sampled or shortened version of an operator would miss."""

import random
import zlib

from textquarry.llm import language_id, licenses, line_dedup


def test_line_dedup_takes_every_repeated_run(spark):
    shared = [[f"run {k} line {i}" for i in range(2 + k % 4)] for k in range(40)]
    own = lambda d, k: [f"text {d} own line {k}"]
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(d, "\n".join(sum((own(d, k) + run for k, run in enumerate(shared)), []) + own(d, "last") + [long] + own(d, "end"))) for d in range(2)]
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].kept == rows[0][1] and got[0].n_removed == 0
    assert got[1].kept.split("\n") == sum((own(1, k) for k in [*range(40), "last", "end"]), [])
    assert got[1].n_removed == sum(map(len, shared)) + 1 and len(got[1].removed) == 41
    assert {i: r.kept for i, r in got.items()} == line_dedup.brute_force(rows)


def test_licenses_across_lines_paragraphs_and_within_lines(spark):
    mit = licenses.TEMPLATES["MIT"][2]
    cut = [mit.index("The above copyright"), mit.index("THE SOFTWARE IS PROVIDED")]
    paragraphs = "\n\n".join([mit[: cut[0]], mit[cut[0] : cut[1]], mit[cut[1] :]])
    body = " ".join(f"word{i} of the other{i}" for i in range(80))
    bsd = licenses.TEMPLATES["BSD-2-Clause"][-1].replace("1. R", "\n\n1. R").replace("THIS SOFTWARE IS", "\n\nTHIS SOFTWARE IS")
    short = "First sentence here. Released under the MIT License. Another sentence follows it."
    texts = [f"{body}\n\n{paragraphs}\n\n{body}", f"Copyright someone\n\n{bsd}", short, f"{paragraphs}\n{bsd}\n{short}\n{paragraphs}", bsd.replace("EVEN IF", f"{short} EVEN IF"), body, None]
    made = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: [(m.start, m.end, m.license, m.dice) for m in r.license_matches] for r in made}
    assert [[m[2] for m in got[i]] for i in range(7)] == [["MIT"], ["BSD-2-Clause"], ["MIT"], ["MIT", "BSD-2-Clause", "MIT", "MIT"], ["BSD-2-Clause", "MIT"], [], []]
    assert got == {i: licenses.brute_force(t) for i, t in enumerate(texts)}
    assert texts[2][slice(*got[2][0][:2])] == "Released under the MIT License"


def test_whole_licences_in_prose(spark):
    r = random.Random(3)
    prose = lambda n: " ".join(r.choice(["river", "stone", "of", "the", "and", "to", "a", "cloud", "tree", "it", "is"]) for _ in range(n))
    names = ["Apache-2.0", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0"]
    whole = {n: licenses.TEMPLATES[n][-1] for n in names}
    assert all(len(t) > 1000 for t in whole.values())
    texts = [f"{prose(200)}\n\n{whole[n]}\n{prose(300)}" for n in names] + [prose(2000)]
    texts.append(whole["Apache-2.0"][: whole["Apache-2.0"].index("APPENDIX")])  # without its appendix
    texts.append(f"{whole['MPL-2.0']} {prose(50)} {whole['BSD-3-Clause'].upper()}")
    made = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: [m.license for m in r.license_matches if m.end - m.start > 1000] for r in made}
    assert [got[i] for i in range(7)] == [[n] for n in names] and got[7] == [] and got[8] == ["Apache-2.0"] and got[9] == ["MPL-2.0", "BSD-3-Clause"]
    for r in made[:7]:
        m = max(r.license_matches, key=lambda m: m.end - m.start)
        found = texts[r.doc_id].encode()[m.start : m.end].decode()
        assert m.dice > 0.98 and abs(len(found) - len(whole[names[r.doc_id]].strip())) < 200


def test_language_id_learns_every_language(spark, monkeypatch):
    r = random.Random(0)
    word = lambda k: "".join(chr(0x4E00 + 20 * k + r.randrange(20)) for _ in range(3))
    rows = [(i, " ".join(word(i % 230) for _ in range(20)), f"l{i % 230:03d}") for i in range(230 * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    made = language_id.fit(df)
    assert made.langs == sorted({x[2] for x in rows})
    got = language_id.predict(df, made).collect()
    assert len({x.lang_pred for x in got}) > 200 and sum(x.lang_pred == x.lang for x in got) > 0.8 * len(got)
    # frequent languages shrink, not the few rows of a rare one
    monkeypatch.setattr(language_id, "SAMPLE_CHARS", 2_000)
    rare = [(i, "abc " * 100, "rare") for i in range(10_000, 10_009)] + [(i, "xyz " * 100, "often") for i in range(4_000)]
    read = {}
    monkeypatch.setattr(language_id, "train", lambda texts, labels: read.update({x: labels.count(x) for x in labels}))
    language_id.fit(spark.createDataFrame(rare, "doc_id long, text string, lang string"))
    learnable = sum(1 for i, *_ in rare[:9] if zlib.crc32(str(i).encode()) % 3 != 1)
    assert read["rare"] == learnable and 5 <= read["often"] <= 60


def test_a_passage_of_many_items_and_documents(spark):
    """Items and documents that all share a passage: the joined form lists what the broadcast form lists."""
    from pyspark.sql import functions as F

    from textquarry.llm import decontamination

    shared = " ".join(f"common{i}" for i in range(15))
    docs = spark.createDataFrame([(i, f"{shared} own{i} " + " ".join(f"x{i}y{j}" for j in range(i % 40)) if i % 3 else f"other text {i}") for i in range(150)], "doc_id long, text string")
    items = spark.createDataFrame([(i, f"Q{i} {shared} end{i}" if i % 2 else f"short item {i}") for i in range(100)] + [(200, "other text 6")], "item_id long, text string")
    made = [sorted(decontamination.annotate(docs, items, block_chars=n).select("doc_id", "contamination.n_words", "contamination.n_hit", F.array_join("contamination.items", ",")).collect()) for n in (0, 1 << 20)]
    assert made[0] == made[1] and sum(r.n_hit > 0 for r in made[0]) == 101
    # no stage pairs documents with items but for those it lists
    plan = decontamination.annotate(docs, items, block_chars=0)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_samples_are_bounded_where_one_id_repeats(spark, monkeypatch):
    from textquarry.llm import language_id, quality

    taken = []
    monkeypatch.setattr(quality, "train", lambda x, y, **k: taken.append(len(y)))
    docs = spark.createDataFrame([(0, f"a text {i}") for i in range(6000)], "doc_id long, text string")
    quality.fit(docs, spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int"), sample_rows=500)
    assert 300 < taken[0] < 800
    monkeypatch.setattr(language_id, "train", lambda texts, langs: taken.append(len(texts)))
    language_id.fit(docs.selectExpr("doc_id", "text", "'en' AS lang"))
    assert taken[1] < 1500
