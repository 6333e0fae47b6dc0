"""Near-duplicates, components and decontamination against brute force, with the odd cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from glyphmill.llm import decontaminate as D
from glyphmill.llm import queries_decontaminate, simhash
from glyphmill.llm.components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def plain_print(text):
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def plain_classes(prints):
    values = np.array(list(prints.values()), dtype=np.uint64)
    ids, sets = list(prints), Union()
    for k in range(len(ids)):
        sets.find(ids[k])
        for j in np.flatnonzero(np.bitwise_count(values[k] ^ values[k + 1 :]) <= 4):
            sets.join(ids[k], ids[k + 1 + int(j)])
    return {i: sets.find(i) for i in ids}


def near_texts(seed=1, n=40):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 200))]
        out.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "changed"
            out.append("\t".join(copy).upper() if rng.random() < 0.3 else " \n".join(copy))
    return [*out, out[0], out[0], None, "", " \n", "one", "One two three", "é" * 300, "long " * 20000]


@pytest.mark.parametrize("hot_pairs", [simhash.HOT_PAIRS, 1])
def test_classes_equal_brute_force(spark, hot_pairs):
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = simhash.find_duplicates(docs, hot_pairs=hot_pairs).collect()
    prints = {i: plain_print(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == plain_classes(prints)
    assert len(rows) == len(texts)


@pytest.mark.parametrize("hot_pairs", [simhash.HOT_PAIRS, 50])
def test_dense_fingerprints(spark, hot_pairs):
    rng = random.Random(3)
    prints = {0}
    for centre in (0, (1 << 64) - 1, 0x5555555555555555):
        for _ in range(150):
            p = centre
            for _ in range(rng.randint(0, 4)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints |= {rng.getrandbits(64) for _ in range(100)}
    signed = {p if p < 1 << 63 else p - (1 << 64): p for p in prints}
    rows = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.links(rows, hot_pairs=hot_pairs)).collect()}
    mine, theirs = {}, {}
    for s in signed:
        mine.setdefault(roots.get(s, s), set()).add(s)
    for s, c in plain_classes(signed).items():
        theirs.setdefault(c, set()).add(s)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_thresholds():
    cost, chosen = simhash.allocate([[5.0, 50.0], [1.0, 3.0], [2.0, 9.0]], 1)
    assert (cost, chosen) == (10.0, [0, 1, 0])
    assert len(simhash.balls(10, 2)) == 56
    total, both = 100, np.eye(64) * 50
    groups = simhash.group_bits(total, both, 5)
    assert sorted(b for g in groups for b in g) == list(range(64))
    counts = np.zeros(8)
    counts[[0, 1, 7]] = [2, 1, 1]
    assert list(simhash._distances(counts)) == pytest.approx([2, 4, 2, 4])


def test_one_document_of_each_class_stays(spark):
    texts = near_texts(2, 15)
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(3, texts[3], 3)] * 2 + [(None, texts[0], 0), (None, "quite alone here", 1), (None, "quite alone here", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    kept = simhash.deduplicate(docs)
    classes = plain_classes({i: plain_print(t) for i, t in enumerate(texts)})
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(classes.values())) and ids.count(None) == 1
    assert simhash.deduplicate(docs.limit(0)).count() == 0 and simhash.find_duplicates(docs.limit(0)).count() == 0


def test_null_ids_do_not_name_a_class(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (None, "z")], "doc_id long, text string")
    assert sorted(map(str, ((r.doc_id, r.component_id) for r in simhash.find_duplicates(docs).collect()))) == ["(5, 5)", "(None, 5)", "(None, None)"]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (200, 150), (150, 170), (170, 200), (None, 3)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(61)} | {150: 150, 170: 150, 200: 150}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- decontamination

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TOKEN.findall(lower)


def plain_hits(text, items, n=10):
    words, hit, ids = plain_words(text), set(), set()
    for item_id, item in items:
        w = plain_words(item)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            window = w[i : i + n]
            for at in range(len(words) - len(window) + 1):
                if words[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    ids.add(item_id)
    named = sorted(str(i) for i in ids if i is not None)
    return len(words), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)


def leak_case():
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta É1 ñ x9".split()) for _ in range(n))
    items = [(i, say(rng.randint(8, 30))) for i in range(12)] + [(50, "short one"), (51, None), (52, "?!"), (50, "short one"), (None, "nameless item here"), (7, say(15))]
    docs = []
    for _ in range(40):
        parts = [say(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items)[1] or ""
            parts += [item.upper().replace(" ", rng.choice([" ", "-", "\n,"])), say(rng.randint(0, 20))]
        docs.append(" ".join(parts))
    return [*docs, None, "", "...", "SHORT, one", "a nameless item here now", "word " * 5000 + (items[0][1] or "")], items


@pytest.mark.parametrize("max_windows", [D.MAX_WINDOWS, 40])
def test_hits_equal_brute_force(spark, max_windows, tmp_path, monkeypatch):
    texts, items = leak_case()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    original = D.find_contamination
    monkeypatch.setattr(D, "find_contamination", lambda *a, **k: original(*a, **(k | {"max_windows": max_windows})))
    rows = queries_decontaminate.op4_decontamination(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == plain_hits(texts[r.doc_id], items), texts[r.doc_id]


def test_removal(spark):
    texts, items = leak_case()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = {i for i, t in enumerate(texts) if not plain_hits(t, items)[4]}
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean
    cut = {r.doc_id: r.text for r in D.decontaminate(docs, bench, remove="spans").collect()}
    assert len(cut) == len(texts)
    for i, t in enumerate(texts):
        n, hit = plain_hits(t, items)[:2]
        assert cut[i] == t if i in clean else len(plain_words(cut[i])) == n - hit
    assert D.decontaminate(docs, bench.limit(0)).count() == len(texts)
    assert D.decontaminate(docs.limit(0), bench).count() == 0
    with pytest.raises(ValueError):
        D.decontaminate(docs, bench, remove="words")
    assert D.cut_spans(b"A b, c!", [[1, 2]]) == b"A , c!"
    assert docs.filter(F.col("text").isNull()).count() == 1
