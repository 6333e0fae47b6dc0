"""Near copies of the pipeline against brute force over all pairs."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from glyphmill.llm import nearcopies

from .test_duplicates_and_leaks import WORD, Union, plain_classes, plain_print


def plain_set(text):
    words = WORD.findall((text or "").encode().lower())
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_jaccard_classes(texts):
    sets, found = [plain_set(t) for t in texts], Union()
    for i, a in enumerate(sets):
        found.find(i)
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= 0.8 * len(a | b):
                found.join(j, i)
    return {i: found.find(i) for i in range(len(texts))}


def test_stage_equals_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randint(0, 4000)}" for _ in range(rng.randint(3, 250))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 8)):
            copy = list(words)
            for _ in range(rng.randint(1, 1 + len(words) // 30)):
                copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            texts.append("\t".join(copy).upper() if rng.random() < 0.3 else " \n".join(copy))
    texts += [texts[0], texts[0], None, "", " \n", "one", "One two three", "ONE  two three", "é" * 300, "long " * 20000]
    want = plain_jaccard_classes(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert nearcopies.deduplicate(docs.limit(0)).count() == 0


def test_simhash_finds_copies_by_itself(spark, monkeypatch):
    # without bands only op3's search is left; what it finds is verified on the shingle sets
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randint(0, 4000)}" for _ in range(600)]
        texts += [" ".join(words), " ".join(words[:-1] + ["other"]), " ".join(words).upper() + " end"]
    for k in range(3):
        texts.append("again " * 3000 + " ".join(f"v{k}_{i}" for i in range(200)))
    texts += [None, ""]
    prints = {i: plain_print(t) for i, t in enumerate(texts)}
    classes, alike = plain_classes(prints), plain_jaccard_classes(texts)
    assert all(classes[i] == alike[i] == i - i % 3 for i in range(36))
    assert classes[37] == classes[38] == 36 and [alike[i] for i in (36, 37, 38)] == [36, 37, 38]
    monkeypatch.setattr(nearcopies, "_banded", lambda nodes: nodes.select("node", "n", F.col("node").alias("band")).limit(0))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(alike.values()))
