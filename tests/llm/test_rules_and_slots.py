"""Quality rules, sharding and mixing against plain versions, with the odd cases."""

import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import mixing, quality_rules, slots
from glyphmill.llm import queries_slots

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))], SCHEMA)


def odd_texts():
    rng = random.Random(5)
    words = "the of a b c d! e# éa 中".split()
    some = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    loop = "one two three four five six seven eight nine "
    return [*some, None, "", " \n\t\x0b", loop * 6, "x\n" * 30, "the word\nthe word\n\nthe word ", "é" * 5000 + " a" * 3000, "a b " * 25, "# * $ % & | < >" * 9]


def plain_measures(text):
    text = text or ""
    words = SPACE.findall(text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if SPACE.search(x)]
    base = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), base)


def test_measures_equal_plain_ones(spark):
    texts = odd_texts()
    rows = quality_rules.apply_rules(frame(spark, texts)).collect()
    for r in rows:
        assert (*(r[m] for m in quality_rules.BASE_MEASURES), r.base_failed) == plain_measures(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.base_failed and r.kept)
        assert r.kept == (not r.base_failed and not r.failed_rules)


def test_rules_with_clashing_columns_and_empty_tables(spark):
    docs = frame(spark, odd_texts()).withColumn("kept", F.lit("mine")).withColumn("N_WORDS", F.lit(1))
    found = quality_rules.apply_rules(docs)
    assert dict(found.dtypes)["kept"] == "boolean" and "N_WORDS" not in found.columns
    own = quality_rules.keep(docs)
    assert own.columns == docs.columns and {r.kept for r in own.collect()} == {"mine"}
    assert quality_rules.keep(docs.limit(0)).count() == 0


def test_a_rule_of_ones_own(spark):
    rules = (quality_rules.Rule("few", "n_words", "<=", 25),)
    rows = quality_rules.apply_rules(frame(spark, ["the w%d " * 24 % tuple(range(24)), "the w%d " * 30 % tuple(range(30))]), rules=rules).collect()
    assert {r.doc_id: (r.kept, r.failed_rules) for r in rows} == {0: (False, ["few"]), 1: (False, ["few"])}


def test_shards(spark, tmp_path):
    texts = [*odd_texts() * 4, *["same text"] * 400]
    ids = [*range(len(texts) - 400), *[7] * 400]
    frame(spark, texts, ids).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries_slots.op1_slot_sharding(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in rows) == sorted(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts)
    )
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert {r.law for r in rows} == {"bytes"} and set(by) <= set(range(24))


def test_copies_of_one_row_are_spread(spark):
    docs = spark.createDataFrame([(1, "abc")] * 4000 + [(i, "x" * 100) for i in range(4000)], "doc_id long, text string")
    for found in (slots.shard_documents(docs, 8), slots.shard_keys(docs, 8)):
        size = F.col("size") if "size" in found.columns else slots.row_size(F.col("text"))
        loads = [r.b for r in found.groupBy("shard").agg(F.sum(size).alias("b")).collect()]
        assert len(loads) == 8 and max(loads) < 1.05 * min(loads)
        assert found.count() == 8000


def plain_map(sizes, n, was=None, tolerance=slots.TOLERANCE):
    """The greedy placement, slot by slot: the largest first, to the emptiest shard."""
    loads, placed = [0] * n, {}
    cap = sum(sizes.values()) * tolerance / n
    order = sorted(sizes, key=lambda s: (-sizes[s], s))
    for s in order if was else ():
        if was.get(s, n) < n and loads[was[s]] + sizes[s] <= cap:
            placed[s] = was[s]
            loads[was[s]] += sizes[s]
    for s in order:
        if s not in placed:
            placed[s] = loads.index(min(loads))
            loads[placed[s]] += sizes[s]
    return placed


def test_placement_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    texts = ["w" * rng.randint(0, 900) for _ in range(500)] + [None, "", "é"]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries_slots.op1_slot_sharding(spark, str(tmp_path)).collect()
    sizes = {}
    for r in rows:
        sizes[r.vslot] = sizes.get(r.vslot, 0) + r["size"]
    first = plain_map(sizes, 24)
    after = plain_map(sizes, 25, first)
    assert all(r.shard == first[r.vslot] and r.next_shard == after[r.vslot] for r in rows)
    assert any(r.next_shard == 24 for r in rows) and all(r.next_shard == r.shard for r in rows if sum(sizes[s] for s in first if first[s] == r.shard) <= sum(sizes.values()) / 25)


def test_slots_are_fixed(spark):
    rows = [(i, f"text {i}") for i in range(300)] + [(1, "text 1")] * 5 + [(None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    where = lambda df, n: {(r.doc_id, r.text, r.vslot) for r in slots.shard_documents(df, n).collect()}
    one = where(docs, 8)
    assert len(one) == 301 and where(docs.repartition(5), 3) == one
    more = docs.union(spark.createDataFrame([(10_000 + i, "y" * 5000) for i in range(100)] + [(-1, "hot")] * 3000, "doc_id long, text string"))
    assert {x for x in where(more, 8) if x[:2] in {y[:2] for y in one}} == one
    assert len({x[2] for x in where(more, 8) if x[0] == -1}) > 8
    plan = slots.shard_documents(more, 8)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 2


def test_map_versions_move_few_bytes(spark, tmp_path):
    store = slots.SlotMap(spark, str(tmp_path / "map"))
    stats = spark.range(500).select(F.col("id").cast("int").alias("slot"), (F.col("id") % 17 + 3).alias("slot_bytes"), F.lit(1).cast("long").alias("slot_rows"))
    assert [store.rebalance(stats, 5), store.rebalance(stats, 6)] == [1, 2]
    moved = store.read(1).select("slot", F.col("shard").alias("a")).join(store.read(2).withColumnRenamed("shard", "b"), "slot").filter("a <> b").collect()
    total = stats.agg(F.sum("slot_bytes")).first()[0]
    assert 0 < sum(r.slot_bytes for r in moved) < 1.05 * total / 6 and {r.b for r in moved} == {5}
    loads = [r[1] for r in store.read(2).groupBy("shard").agg(F.sum("slot_bytes")).collect()]
    assert len(loads) == 6 and max(loads) < 1.03 * total / 6
    assert store.rebalance(stats, 3) == 3 and store.read().agg(F.max("shard")).first()[0] == 2


def test_nothing_to_shard(spark):
    assert slots.shard_documents(frame(spark, ["a"]).limit(0), 4).count() == 0
    assert slots.shard_keys(frame(spark, ["a"]).limit(0), 4).count() == 0
    with pytest.raises(ValueError):
        slots.place(spark.createDataFrame([], "slot int, slot_bytes long, slot_rows long"), 0)


def test_sharding_keeps_columns(spark):
    docs = frame(spark, odd_texts()).withColumn("Shard", F.lit("old")).withColumn("slot", F.lit(3))
    found = slots.shard_documents(docs, 4)
    assert [c for c in found.columns if c not in ("vslot", "shard")] == [c for c in docs.columns if c != "Shard"]
    assert found.drop("vslot", "shard").exceptAll(docs.drop("Shard")).isEmpty()


def plain_copies(key, rate, seed):
    import hashlib

    u = int(hashlib.md5(f"{seed}|{key}".encode()).hexdigest()[:13], 16) / 2**52
    p = c = math.exp(-rate)
    n = 0
    while c <= u and n < 300:
        n += 1
        p *= rate / n
        c += p
    return n


def test_mixing_hits_its_rates(spark):
    rows = [(i, "x" * 10, "en", "big" if i % 3 else "small", 10) for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix(docs, weights={"big": 0.5, "small": 0.5})
    rates = {r.source: r.rate for r in found.select("source", "rate").distinct().collect()}
    assert rates == {"big": 0.75, "small": 1.5}
    copies = {r.doc_id: r["count"] for r in found.groupBy("doc_id").count().collect()}
    for i, _, _, source, _ in rows:
        assert copies.get(i, 0) == plain_copies(str(i), rates[source], mixing.SEED)
    by = {r.source: r["count"] for r in found.groupBy("source").count().collect()}
    assert abs(by["big"] / 1500 - 1) < 0.1 and abs(by["small"] / 1500 - 1) < 0.1
    again = mixing.mix(docs.repartition(7), weights={"big": 0.5, "small": 0.5})
    assert found.exceptAll(again).isEmpty() and again.exceptAll(found).isEmpty()


def test_mixing_odd_rows(spark):
    docs = spark.createDataFrame(
        [(None, "a", "en", None, 1), (None, "b", None, None, 1), (1, None, "en", "x", 0), (2, "", "en", "y", 0), (3, "zz", "en", "y", 2), (3, "zz", "en", "y", 2)],
        SCHEMA,
    ).withColumn("RATE", F.lit("own"))
    found = mixing.mix(docs, total=100.0)
    assert found.filter("source is null").count() > 0 and found.filter("source = 'x'").count() == 0
    same = [r.n_copies for r in found.filter("doc_id = 3 and copy_no = 0").collect()]
    assert len(same) == 2 and len(set(same)) == 1
    assert found.columns == [*docs.columns[:-1], *mixing.OUTPUTS]
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs, weights={"y": 0.0}).filter("source = 'y'").count() == 0
    with pytest.raises(Exception, match="rate above the limit"):
        mixing.mix(docs, total=1e6).count()
