"""Both learners on worked cases, against plain replays, and in distributed rounds."""

import random
import tracemalloc

import pytest

from glyphmill import queries as Q
from glyphmill.config import Settings
from glyphmill.operators import learn as L
from glyphmill.operators import segment as S


def merges(spark, words, n, semantics):
    counts = spark.createDataFrame(list(words.items()), "token string, cnt long")
    rows = L.replay_merges(counts, n, semantics).orderBy("merge_no").collect()
    return [(r.left, r.right, r.cnt, r.phantom) for r in rows]


LOW = {"low": 5, "lower": 2, "newest": 6, "widest": 3}
FIRST = [("e", "s", 9), ("es", "t", 9), ("est", "</w>", 9), ("l", "o", 7), ("lo", "w", 7), ("e", "w", 6), ("ew", "est</w>", 6), ("n", "ewest</w>", 6)]


@pytest.mark.parametrize("semantics", ["literal", "canonical"])
def test_worked_example(spark, semantics):
    assert [m[:3] for m in merges(spark, LOW, 8, semantics)] == FIRST


def test_neighbouring_repeats_differ(spark):
    words = {"abab": 3, "cab": 1}
    assert merges(spark, words, 6, "literal") == [
        ("a", "b", 7, False), ("ab", "</w>", 4, False), ("ab", "a", 3, True), ("ab", "ab</w>", 3, False),
        ("b", "ab", 3, True), ("c", "ab</w>", 1, False),
    ]
    assert [m[:3] for m in merges(spark, words, 6, "canonical")] == [
        ("a", "b", 7), ("ab", "</w>", 4), ("ab", "ab</w>", 3), ("c", "ab</w>", 1)
    ]


def test_runs_of_one_letter(spark):
    words = {"aaa": 2, "aaaa": 1}
    assert [m[:3] for m in merges(spark, words, 4, "literal")] == [("a", "a", 7), ("aa", "a", 3), ("aaa", "</w>", 2), ("a", "aa", 1)]
    assert merges(spark, words, 4, "literal")[3][3]
    assert [m[:3] for m in merges(spark, words, 4, "canonical")] == [("a", "a", 7), ("a", "</w>", 2), ("aa", "a</w>", 2), ("aa", "</w>", 1)]


def test_ties_take_the_smallest_pair(spark):
    assert [m[:3] for m in merges(spark, {"xy": 1, "ab": 1}, 4, "canonical")] == [("a", "b", 1), ("ab", "</w>", 1), ("x", "y", 1), ("xy", "</w>", 1)]


def test_nothing_to_learn(spark):
    assert merges(spark, {"a": 1, ".": 2, "</s>": 1}, 5, "literal") == []


def textbook(words, n):
    parts = {w: [*w, "</w>"] for w in words}
    out = []
    for _ in range(n):
        stats = {}
        for w, p in parts.items():
            for pair in zip(p, p[1:]):
                stats[pair] = stats.get(pair, 0) + words[w]
        if not stats:
            break
        best = min(stats, key=lambda q: (-stats[q], q))
        out.append((*best, stats[best]))
        for w, p in parts.items():
            new, k = [], 0
            while k < len(p):
                if k + 1 < len(p) and (p[k], p[k + 1]) == best:
                    new.append(p[k] + p[k + 1])
                    k += 2
                else:
                    new.append(p[k])
                    k += 1
            parts[w] = new
    return out


def full_scan(words, n):
    """The literal rule once more, with full scans for the maximum."""
    parts = {w: [*w, "</w>"] for w in sorted(words)}
    stats, places, out = {}, {}, []
    for w, p in parts.items():
        for pair in zip(p, p[1:]):
            stats[pair] = stats.get(pair, 0) + words[w]
            places.setdefault(pair, []).append(w)
    for _ in range(n):
        if not stats:
            break
        best = min(stats, key=lambda q: (-stats[q], q))
        a, b = best
        out.append((a, b, stats[best]))
        for w in list(places.get(best, [])):
            p, new, k = parts[w], [], 0
            while k < len(p):
                if p[k : k + 2] != [a, b]:
                    new.append(p[k])
                    k += 1
                    continue
                for cond, old, made in ((k > 0, (p[k - 1], a), (p[k - 1], a + b)), (k + 2 < len(p), (b, p[min(k + 2, len(p) - 1)]), (a + b, p[min(k + 2, len(p) - 1)]))):
                    if cond:
                        stats[old] = stats.get(old, 0) - words[w]
                        if stats[old] <= 0:
                            del stats[old]
                        stats[made] = stats.get(made, 0) + words[w]
                        places.setdefault(made, []).append(w)
                new.append(a + b)
                k += 2
            parts[w] = new
        places.pop(best, None)
        stats.pop(best, None)
    return out


def some_words(seed, n=60):
    rng = random.Random(seed)
    return {"".join(rng.choice("abc") for _ in range(rng.randint(2, 9))): rng.randint(1, 9) for _ in range(n)}


@pytest.mark.parametrize("seed", range(4))
def test_replay_equals_plain_versions(spark, seed):
    words = some_words(seed)
    assert [m[:3] for m in merges(spark, words, 60, "canonical")] == textbook(words, 60)
    assert [m[:3] for m in merges(spark, words, 60, "literal")] == full_scan(words, 60)


@pytest.mark.parametrize("top", [3, 2000])
def test_distributed_rounds_give_the_same_merges(spark, top):
    words = some_words(9, 30)
    counts = spark.createDataFrame(list(words.items()), "token string, cnt long")
    rows = L.distributed_merges(counts, 14, top).orderBy("merge_no").collect()
    assert [(r.left, r.right, r.cnt) for r in rows] == textbook(words, 14)


def test_safe_prefix():
    assert L.safe_prefix([("a", "b", 9), ("c", "d", 8), ("b", "e", 7)], True) == [("a", "b", 9), ("c", "d", 8)]
    assert L.safe_prefix([("a", "b", 9), ("c", "d", 7), ("b", "e", 7)], True) == [("a", "b", 9)]
    assert L.safe_prefix([("a", "b", 9), ("c", "d", 7), ("e", "f", 7)], False) == [("a", "b", 9)]


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Settings(semantics="other")


def vocabulary(spark):
    tokens = {a + b for a, b, _ in FIRST} | set("".join(LOW)) | {"</w>", "</s>"}
    return spark.createDataFrame([(t,) for t in sorted(tokens)], "token string")


def test_segments(spark):
    words = {
        "low": "low </w>", "lowest": "low est</w>", "newer": "n ew e r </w>", "west": "w est</w>", "quiz": "q u i z </w>", "a": "a </w>", "": "",
    }
    rows = S.segment_words(spark.createDataFrame([(w,) for w in words], "word string"), vocabulary(spark)).collect()
    assert {r.word: " ".join(r.pieces) for r in rows} == words


def test_sentences_are_not_case_split(spark):
    rows = spark.createDataFrame([("NewLow 2.9 é",), (None,), ("",)], "text string")
    found = [r.tokens for r in S.segment_sentences(rows, vocabulary(spark)).collect()]
    assert found[0] == ["n", "ew", "low", "</w>", "2", ".", "9", "Ã", "©"]
    assert found[1] == found[2] == []


def test_token_stats_have_every_token(spark):
    counts = spark.createDataFrame([("low", 5), ("quiz", 1), (".", 2)], "token string, cnt long")
    stats = {r.token: r.cnt for r in S.token_stats(counts, vocabulary(spark)).collect()}
    assert stats["low"] == 5 and stats["."] == 2 and stats["newest</w>"] == 0 and stats["z"] == 1 and stats["</w>"] == 6
    assert {r.token for r in S.strays(S.token_stats(counts, vocabulary(spark)), vocabulary(spark)).collect()} == {"q", "u", "z", "."}


def test_literal_learning_has_a_limit(spark, monkeypatch):
    monkeypatch.setattr(L, "LOCAL_WORDS", 3)
    counts = spark.createDataFrame([(w, 2) for w in ("abab", "cab", "bca", "abc")], "token string, cnt long")
    with pytest.raises(ValueError, match="canonical"):
        L.learn_merges(counts, Settings(num_merges=4))
    far = L.learn_merges(counts, Settings(num_merges=4, semantics="canonical")).collect()
    assert far == L.replay_merges(counts, 4, "canonical").collect()


def letters(n):
    rng = random.Random(3)
    return sorted({"".join(rng.choice("etaoinshrdlu") for _ in range(11)) for _ in range(n)})


def megabytes(made):
    """At most, while something is made; it, too."""
    tracemalloc.start()
    held = made()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6, held


@pytest.mark.parametrize("semantics", ["literal", "canonical"])
def test_replay_holds_numbers_not_objects(monkeypatch, semantics):
    monkeypatch.setattr(L, "BLOCK", 1_000)
    words = letters(60_000)

    def learned():
        held = L.Words(30)
        for k in range(0, len(words), 10_000):
            held.add(words[k : k + 10_000], [1] * len(words[k : k + 10_000]))
        return list(L.Replay(held, semantics == "literal").merges(30))

    most, rows = megabytes(learned)
    assert len(rows) == 30 and most < 12, most


@pytest.mark.parametrize("seed", range(3))
def test_replay_in_blocks(monkeypatch, seed):
    monkeypatch.setattr(L, "BLOCK", 2)
    words = {w.replace("c", "aé"): n for w, n in some_words(seed).items()}
    for literal, plain in ((True, full_scan), (False, textbook)):
        held = L.Words(70)
        for word in sorted(words):
            held.add([word], [words[word]])
        assert [m[1:3] + m[4:5] for m in L.Replay(held, literal).merges(70)] == plain(words, 70)


def test_a_worker_keeps_few_words():
    words = letters(60_000)
    of = S.Segmenter(frozenset("etaoinshrdlu") | {"</w>", "th"})
    most, _ = megabytes(lambda: sum(len(of.word(w)) for w in words))
    assert most < 8 and of.word("th")[0] is next(t for t in of.tokens if t == "th"), most


def test_kept_words_change_nothing(monkeypatch):
    of, words = S.Segmenter(frozenset({"low", "est</w>", "e"})), ["low", "lowest", "", "e", "low", "lowest"]
    whole = [of.word(w) for w in words]
    monkeypatch.setattr(S, "MOST_KEPT", 1)
    assert [S.Segmenter(frozenset({"low", "est</w>", "e"})).sentence(" ".join(words))] == [sum(whole, [])]


def test_vocabularies_of_many_words_are_learned_in_rounds(spark, small, monkeypatch):
    one_task = {r.token for r in Q.vocabulary_ranked(spark, small).collect()}
    monkeypatch.setattr(L, "LOCAL_WORDS", 3)
    rounds = []
    plain = L.distributed_merges
    monkeypatch.setattr(L, "distributed_merges", lambda *args: rounds.append(args) or plain(*args))
    assert {r.token for r in Q.vocabulary_ranked(spark, small).collect()} == one_task and len(rounds) == 1
