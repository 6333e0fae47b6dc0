"""The pipeline against its stages' plain versions, stage by stage."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from glyphmill.llm import mixing
from glyphmill.llm.common import materialise

from .test_duplicates_and_leaks import plain_hits
from .test_near_copies import plain_jaccard_classes
from .test_rules_and_slots import plain_copies, plain_measures


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    stock = [f"{rng.choice('bcdfgh')}{rng.choice('aeiou')}{k}" for k in range(300)] + ["the", "of", "and"] * 20
    say = lambda n: " ".join(rng.choice(stock) for _ in range(n))
    items = [(k, say(20)) for k in range(3)]
    texts = [say(rng.randint(5, 120)) for _ in range(80)]
    texts += [t + " more" for t in texts[:10]] + texts[:5] + [say(30) + " " + items[1][1] + " " + say(30), None, "", "# " * 40]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = {i: t for i, t in enumerate(texts) if not plain_measures(t)[5]}
    order = sorted(kept)
    classes = plain_jaccard_classes([kept[i] for i in order])
    kept = {i: kept[i] for k, i in enumerate(order) if classes[k] == k}
    kept = {i: t for i, t in kept.items() if not plain_hits(t, items)[4]}
    sizes = {}
    for i, t in kept.items():
        sizes[f"s{i % 3}"] = sizes.get(f"s{i % 3}", 0) + len((t or "").encode())
    total = sum(sizes.values())
    weights = {s: round((n / total) ** 0.7, 12) for s, n in sizes.items()}
    rates = {s: round(total * weights[s] / sum(weights.values()) / n, 9) for s, n in sizes.items()}
    want = {i: plain_copies(str(i), rates[f"s{i % 3}"], mixing.SEED) for i in kept}

    out = materialise(corpus_pipeline.run(spark, str(tmp_path)), "out")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "vslot", "shard"]
    got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert got == {i: n for i, n in want.items() if n}
    assert all(r.text == texts[r.doc_id] for r in out.collect())
    assert out.filter((F.col("shard") < 0) | (F.col("shard") >= corpus_pipeline.N_SHARDS)).isEmpty()


def test_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns, name
        assert stage(spark, docs.limit(0), small).count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "mixing", "sharding"]
