"""Entities that stand alone in a text, next to punctuation or without a digit."""

import time
from itertools import product

import pytest

from glyphmill.llm import surrogates
from glyphmill.llm.surrogates import _IS_HEX, _POOL_OF, Surrogates, find_entities


@pytest.mark.parametrize(
    "text, name",
    [
        ('He met "Mary Smith" there.', "Mary Smith"),
        ("(John Miller)", "John Miller"),
        ("<b>Mary Smith</b>", "Mary Smith"),
        ("Jean-Pierre Dupont", "Jean-Pierre Dupont"),
        ("so,Mr. Brown", "Mr. Brown"),
        ("«Иван Петров»", "Иван Петров"),
    ],
)
def test_names_next_to_punctuation(text, name):
    assert [(text[s:e], kind) for s, e, kind in find_entities(text)] == [(name, "person")]
    made, found = Surrogates(b"k").rewrite(text)
    assert not set(name.replace("-", " ").split()) - {"Mr."} & set(made.replace("-", " ").split())
    assert len(found) == 1 and name not in made


@pytest.mark.parametrize("key", ["ghp_" + "abcdEFGH" * 5, "sk-" + "abcdefghij" * 3, "xoxb-abcdefghijkl", "AKIA" + "ABCDEFGH" * 2])
def test_access_keys_without_a_digit(key):
    text = f"use {key} here"
    assert [kind for *_, kind in find_entities(text)] == ["access_key"]
    assert key not in Surrogates(b"k").rewrite(text)[0]


@pytest.mark.parametrize("secret", ["password=" + "aB3$" * 200, "use sk-" + "a1B2" * 100, "x eyJ" + "a" * 40 + "." + "b" * 9000 + "." + "c" * 2000, "m" * 300 + "@mail.example.org"])
def test_long_secrets_go_whole(secret):
    made, found = Surrogates(b"k").rewrite(f"so {secret} end")
    assert len(found) == 1 and found[0][1] in secret and len(found[0][2]) == len(found[0][1])
    assert not any(secret[k : k + 40] in made for k in range(12, len(secret) - 40, 7))


def test_names_alone_follow_their_person():
    s = Surrogates(b"k")
    made, found = s.rewrite("John Smith arrived. Smith left, John stayed; Smithers too. Dr. Priya Kumar saw Kumar.")
    by = {o: m for _, o, m in found}
    assert [o for _, o, _ in found] == ["John Smith", "Smith", "John", "Dr. Priya Kumar", "Kumar"]
    assert by["John Smith"] == f"{by['John']} {by['Smith']}" and by["Dr. Priya Kumar"].endswith(by["Kumar"]) and "Smithers" in made
    assert s.rewrite("Smith and Kumar were here.")[1] == []


def test_hexadecimal_forms_are_closed():
    s = Surrogates(b"k")
    strings = [f"{c}{k:07d}" for c in "abfz" for k in range(0, 4000)] + [f"{k:08x}" for k in range(0, 60000, 7)]
    made = {x: s.by.text("t", x) for x in dict.fromkeys(strings)}
    assert len(set(made.values())) == len(made) and all(a != b for a, b in made.items())
    assert all(bool(_IS_HEX.fullmatch(a)) == bool(_IS_HEX.fullmatch(b)) for a, b in made.items())
    assert s.by.text("t", "密码密码密码") != "密码密码密码" and s.by.text("t", "!!??!!") != "!!??!!"


@pytest.mark.parametrize("size", [1, 2, 3])
def test_small_formats_are_permuted(size):
    s = Surrogates(b"k")
    words = ["".join(w) for w in product("aeb", repeat=size)]
    every = {w: s.by.text("t", w, True) for w in words}
    assert len(set(every.values())) == len(every)
    names = [a + b for a in "BCDFG" for b in "aeiouy"] + list(_POOL_OF)
    assert len({s.first_name(n) for n in names}) == len(set(names))


def test_many_entities_take_linear_time():
    text = " ".join(f"user{k}@mail.example.org" for k in range(20_000))
    at = time.process_time()
    assert len(find_entities(text)) == 20_000
    assert time.process_time() - at < 5
    at = time.process_time()
    assert find_entities("%" * 200_000 + "a" * 200_000) == []
    assert time.process_time() - at < 5


def test_a_collision_is_raised(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "call 212-555-1234"), (2, "call 212-555-1235"), (3, None)], "doc_id long, text string")
    assert surrogates.replace_checked(docs).count() == 3
    one = spark.createDataFrame([("ip", "a", "c", 1), ("ip", "b", "c", 1)], "kind string, original string, surrogate string, n long")
    monkeypatch.setattr(surrogates, "entities", lambda *_: one)
    with pytest.raises(ValueError, match="apart"):
        surrogates.replace_checked(docs)
