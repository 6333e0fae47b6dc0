"""Language identification and toxicity: held-out accuracy and the odd cases."""

import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import language, queries_language, queries_toxicity, toxicity

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    rows = queries_language.op2_language_id(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows.count() == docs.count()
    joined = rows.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in joined)
    held = [r for r in joined if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "le chat et le chien", "fr"), (4, "el gato y el perro", "es")] * 3
    learn = spark.createDataFrame([(10 * i + k, t, l) for k in range(3) for i, t, l in rows] + [(999, "x", None), (None, "y", "en")], "doc_id long, text string, lang string")
    model = language.fit(learn)
    odd = spark.createDataFrame(
        [(1, None), (2, ""), (3, "123 !?"), (4, "the"), (5, "the cat " * 40000), (6, "der hund"), (7, "der hund")], "doc_id long, text string"
    ).withColumn("Score", F.lit("own"))
    found = language.predict(odd, model)
    got = {r.doc_id: (r.lang_pred, r.score) for r in found.collect()}
    assert found.columns == ["doc_id", "text", "lang_pred", "score"]
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert got[4][0] == got[5][0] == "en" and got[6] == got[7] and got[6][0] == "de"
    assert language.fit(learn.filter("lang is null")) is None
    assert {r.lang_pred for r in language.predict(odd, None).collect()} == {"und"}
    one = language.fit(learn.filter("lang = 'fr'"))
    assert language.predict(odd, one).filter("doc_id = 4").first().lang_pred == "fr"
    assert language.predict(odd.limit(0), model).count() == 0


def test_machines_separate():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 20)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1.0, -1.0)
    w = language.fit_svm(x, y)
    assert ((np.hstack([x, np.ones((300, 1))]) @ w > 0) == (y > 0)).mean() > 0.97


def test_toxicity_of_held_out_documents(spark):
    rows = queries_toxicity.op7_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = rows.join(labels, "doc_id").filter("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in held)
    hits = sum(r.predicted == r.toxic for r in held) / len(held)
    caught = [r.predicted for r in held if r.toxic]
    assert hits > 0.96 and sum(caught) / len(caught) > 0.8


def test_toxicity_odd_rows(spark):
    texts = [(i, "you are a nasty villain" if i % 2 else "you are a kind friend") for i in range(200)]
    docs = spark.createDataFrame([*texts, (500, None), (501, ""), (502, "a nasty villain " * 20000), (1, texts[1][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    found = toxicity.score(docs.withColumn("PREDICTED", F.lit("own")), machine)
    assert found.columns == ["doc_id", "text", "score", "predicted"]
    got = {r.doc_id: r for r in found.collect()}
    assert got[1].predicted == 1 and got[2].predicted == 0 and got[502].predicted == 1
    assert got[500].score == got[501].score and got[500].predicted == 0
    for some, share in ((labels.filter("toxic = 0"), 0.0), (labels.limit(0), 0.0), (labels.filter("toxic = 1"), 1.0)):
        flat = toxicity.score(docs, toxicity.fit(docs, some)).agg(F.min("score").alias("a"), F.max("score").alias("b")).first()
        assert flat.a == flat.b == pytest.approx(share, abs=1e-6)
    assert toxicity.score(docs.limit(0), machine).count() == 0


def test_pairs_of_terms_count_together():
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for _ in range(400):
        a, b = rng.random(2) < 0.5
        rows.append(np.array([k for k, on in enumerate((a, b)) if on] + [2], np.int64))
        labels.append(float(a and b))
    machine = toxicity.Machine(np.arange(3), 0.0)
    machine.fit(rows, np.array(labels))
    assert machine.score([0, 1, 2]) > 0.9 and machine.score([0, 2]) < 0.1 and machine.score([1, 2]) < 0.1


class Additive(toxicity.Machine):
    """The same machine without its pairs: vectors that begin at zero stay there."""

    def __init__(self, terms, bias):
        super().__init__(terms, bias)
        self.v[:] = 0


def shares(spark, docs, truth, machine):
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, machine).collect() if r.doc_id >= 2000}
    hit = sum(1 for i, p in got.items() if p and truth[i])
    return hit / max(sum(got.values()), 1), hit / sum(truth[i] for i in got)


def test_words_that_are_harmful_together(spark, monkeypatch):
    # one of two insults with the group that it aims at; with the other group it is none, so no sum of weights decides
    rng = np.random.default_rng(4)
    fill = [f"{a}{b}{c}" for a in ("kor", "mel", "tas", "vin") for b in ("bu", "da", "fi") for c in ("lan", "rep", "sot")]
    texts, truth = [], {}
    for i in range(4000):
        insult, group = rng.integers(0, 3, 2)
        words = list(rng.choice(fill, 30)) + [["grubber", "pigwhistle", "sunny"][insult], ["northlander", "eastfolk", "evening"][group]]
        rng.shuffle(words)
        texts.append((i, " ".join(words)))
        truth[i] = int(insult == group < 2)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, truth[i]) for i in range(2000)], "doc_id long, toxic int")
    precision, recall = shares(spark, docs, truth, toxicity.fit(docs, labels))
    assert precision >= 0.95 and recall >= 0.95
    monkeypatch.setattr(toxicity, "Machine", Additive)
    assert min(shares(spark, docs, truth, toxicity.fit(docs, labels))) < 0.8


def test_a_neutral_word_is_found_beside_an_insult(spark):
    # the mention is as frequent in toxic texts as in others; it counts next to the insult only
    rng = np.random.default_rng(5)
    texts, truth = [], {}
    for i in range(6000):
        kind = i % 10
        insult, mention, other = kind in (0, 1), kind in (0, 2, 3, 4), kind in (5, 6)
        words = list(rng.choice(["kordal", "melfin", "tasbul", "vinrep", "sotlan"], 12))
        words += ["grubber"] * insult + ["northlander"] * mention + ["vilestuff"] * (other and kind == 5)
        rng.shuffle(words)
        texts.append((i, " ".join(words)))
        truth[i] = int((insult and mention) or kind == 5)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(i, truth[i]) for i in range(2000)], "doc_id long, toxic int")
    precision, recall = shares(spark, docs, truth, toxicity.fit(docs, labels))
    assert precision >= 0.95 and recall >= 0.95


def plain_score(machine, active):
    raw = machine.bias + sum(machine.w[i] for i in active)
    raw += sum(float(machine.v[i] @ machine.v[j]) for n, i in enumerate(active) for j in active[n + 1 :])
    return 1 / (1 + np.exp(-raw))


def test_scores_equal_all_pairs():
    rng = np.random.default_rng(6)
    machine = toxicity.Machine(np.arange(50), 0.3)
    machine.w, machine.v = rng.normal(size=50), rng.normal(size=(50, 8))
    for n in (0, 1, 2, 7, 20):
        active = sorted(rng.choice(50, n, replace=False).tolist())
        assert machine.score(active) == pytest.approx(plain_score(machine, active), abs=1e-9)


def test_the_fit_holds_numbers_for_one_block_of_rows(monkeypatch):
    rng = np.random.default_rng(7)
    rows = [rng.choice(3000, 100, replace=False).astype(np.int32) for _ in range(12_000)] + [np.empty(0, np.int32)]
    labels = np.array([float(0 in r or 1 in r) for r in rows])
    machine = toxicity.Machine(np.arange(3000), 0.0)
    tracemalloc.start()
    machine.fit(rows, labels, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 * sum(map(len, rows))  # bytes; all rows at once need more than 200 for each of their terms
    fitted = []
    for block in (toxicity.BLOCK, 1):
        monkeypatch.setattr(toxicity, "BLOCK", block)
        small = toxicity.Machine(np.arange(3000), 0.0)
        small.fit(rows[-300:], labels[-300:], steps=20)
        fitted.append([small.score(r.tolist()) for r in rows[-300:]])
    assert fitted[0] == pytest.approx(fitted[1], abs=1e-6)


def test_a_step_of_the_fit_reads_a_batch_and_the_steps_read_all_rows(monkeypatch):
    rng = np.random.default_rng(8)
    plain, read = np.bincount, []
    monkeypatch.setattr(np, "bincount", lambda x, *rest: read.append(len(x)) or plain(x, *rest))
    for n, batch in ((20_000, toxicity.BATCH), (2000, 1)):
        # every row has a term of its own: the weight of one that no step read would stay zero
        rows = [np.array([i, n + i % 2], np.int32) for i in range(n)]
        labels = (rng.random(n) < 0.1).astype(np.float64)
        monkeypatch.setattr(toxicity, "BATCH", batch)
        machine = toxicity.Machine(np.arange(n + 2), 0.0)
        read.clear()
        machine.fit(rows, labels)
        assert sum(read) < 0.3 * 600 * (2 + 2 * toxicity.FACTORS) * sum(map(len, rows))  # all rows in each step: 1.0 or more
        assert np.array_equal(machine.w[:n] > 0, labels > 0) and machine.w[:n].all()
        assert [machine.score(r.tolist()) >= 0.5 for r in rows] == (labels > 0).tolist()


def test_repeated_rows_do_not_fill_the_sample(spark):
    hot = [(1, "the cat and the dog", "en")] * 3000
    rest = [(10 + i, ["the cow and the cat", "der hund und die kuh"][i % 2] + f" x{i}", ["en", "de"][i % 2]) for i in range(40)]
    docs = spark.createDataFrame(hot + rest, "doc_id long, text string, lang string")
    rows = docs.select(F.col("doc_id").cast("string").alias("key"), F.xxhash64("text").alias("text_hash"), "lang")
    assert sorted(r.key for r in language.training_rows(rows, 500).collect()) == sorted(["1", *map(str, range(10, 50))])
    by = {r.lang: r["count"] for r in language.training_rows(rows, 10).groupBy("lang").count().collect()}
    assert by == {"en": 5, "de": 5}
    model = language.fit(docs)
    assert language.predict(docs.filter("doc_id = 11"), model).first().lang_pred == "de"
    labels = spark.createDataFrame([(1, 1)] * 2000 + [(10 + i, i % 2) for i in range(40)], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    assert toxicity.score(docs.filter("doc_id = 11"), machine).first().predicted == 1
