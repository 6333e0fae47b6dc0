"""Byte lexing, case splits and word counts on hand-sized inputs."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import counts as C
from glyphmill.sources import corpus


def counted(spark, *texts):
    rows = C.word_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    return {r.token: r.cnt for r in rows}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("", {}),
        (None, {}),
        ("\n", {"</s>": 1}),
        ("one", {"one": 1, "</s>": 1}),
        (
            'MyHTTPRequest camelCase A1b2\r\n\ncafé, "x"\n',
            {"my": 1, "http": 1, "request": 1, "camel": 1, "case": 1, "a": 1, "1": 1, "b": 1, "2": 1, "caf": 1,
             "Ã": 1, "©": 1, ",": 1, '"': 2, "x": 1, "</s>": 3},
        ),
        ("a\vb\0", {"a": 1, "b": 1, "\0": 1, "</s>": 1}),
    ],
)
def test_word_counts(spark, text, expected):
    assert counted(spark, text) == expected


def test_lines_do_not_depend_on_the_split(spark):
    whole = counted(spark, "a b\nB\n\nc")
    assert whole == counted(spark, "a b\n", "B\n", "\n", "c\n")
    assert whole["</s>"] == 4


def test_camel_pieces(spark):
    words = {
        "MyHTTPRequest": ["My", "HTTP", "Request"], "HTTP": ["HTTP"], "iPhone": ["i", "Phone"], "ABc": ["A", "Bc"],
        "aB": ["a", "B"], "XMLHttp": ["XML", "Http"], "": [],
    }
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.camel_pieces(F.col("w")).alias("p")).collect()
    assert {r.w: r.p for r in rows} == words


def test_candidates_and_atoms_part_the_counts(spark):
    counts = spark.createDataFrame([("a", 1), ("ab", 2), ("1", 3), ("</s>", 4), ("é", 5)], "token string, cnt long")
    assert {r.token for r in C.merge_candidates(counts).collect()} == {"ab"}
    assert {r.token for r in C.atomic_tokens(counts).collect()} == {"a", "1", "</s>", "é"}
    assert {r.token for r in C.base_vocabulary(counts).collect()} == {"a", "b", "1", "é", "</s>", "</w>"}


def test_base_vocabulary_without_words_has_no_word_end(spark):
    counts = spark.createDataFrame([("a", 1), (".", 2), ("</s>", 4)], "token string, cnt long")
    assert {r.token for r in C.base_vocabulary(counts).collect()} == {"a", ".", "</s>"}


def test_pairs(spark):
    counts = spark.createDataFrame([("abab", 3), ("cab", 1)], "token string, cnt long")
    stats = {(r.left, r.right): r.cnt for r in C.pair_stats(C.initial_splits(counts)).collect()}
    assert stats == {("a", "b"): 7, ("b", "a"): 3, ("b", "</w>"): 4, ("c", "a"): 1}
    index = {(r.left, r.right, r.word): r.times for r in C.pair_index(C.initial_splits(counts)).collect()}
    assert index[("a", "b", "abab")] == 2
    assert C.best_pair(C.pair_stats(C.initial_splits(counts))).first()[:2] == ("a", "b")


def test_total_of_pairs_is_total_of_letters(spark, small):
    counts = C.word_counts(corpus.texts_of_table(spark.read.parquet(f"{small}/documents.parquet")))
    pairs = C.pair_stats(C.initial_splits(counts)).agg(F.sum("cnt")).first()[0]
    letters = C.merge_candidates(counts).agg(F.sum(F.col("cnt") * F.length("token"))).first()[0]
    assert pairs == letters


def test_partitions_do_not_matter(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one = C.word_counts(corpus.texts_of_table(docs.coalesce(1)))
    many = C.word_counts(corpus.texts_of_table(docs.repartition(13)))
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


def test_small_text_functions(spark):
    def run(f, *values):
        rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
        return [r.x for r in rows.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]

    assert run(T.trimmed, " \t a b \r\n", "") == ["a b", ""]
    assert run(T.unquoted, '"a""b"', "'a''b'", '"', "ab") == ['a"b', "a''b", '"', "ab"]
    assert run(T.csv_field, "a", "", " ", "a,b", 'a"b', "a\nb") == ["a", '""', '" "', '"a,b"', '"a""b"', '"a\nb"']
    assert run(T.looks_like_header, "token,count", "word,count", "TOKEN, Repetitions", "my embedding", "the,12") == [True] * 4 + [False]
    assert run(T.line_count, "", "a", "a\n", "\n\n", None) == [0, 1, 1, 2, 0]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one two\r\nthree")
    (tmp_path / "_b.dat").write_bytes(b"\xff\n\n")
    (tmp_path / "c.gz").write_bytes(b"not pressed\n")
    (tmp_path / "d").write_bytes(b"\xfe\xc3 caf\xc3\xa9\n")
    (tmp_path / "k=v").mkdir()
    (tmp_path / "k=v" / "e.txt").write_bytes(b"below\n")
    every = corpus.read_lines(spark, str(tmp_path))
    assert sorted(r.line for r in every.collect()) == ["", "not pressed", "one two\r", "three", "\xfe\xc3 caf\xc3\xa9", "\xff"]
    every = every.filter("not (path like '%.gz' or path like '%/d')")
    counts = {r.token: r.cnt for r in C.word_counts(corpus.texts_of_lines(every), is_bytes=True).collect()}
    assert counts == {"one": 1, "two": 1, "three": 1, "\xff": 1, "</s>": 4}
    assert corpus.count_file_lines(spark, str(tmp_path / "a.txt")) == 2
    assert corpus.count_file_lines(spark, str(tmp_path / "none")) == -1
    assert corpus.corpus_bytes(spark, str(tmp_path / "a.txt")) == 14


def test_ranges_of_bytes(tmp_path):
    rng = random.Random(3)
    for data in (b"", b"\n", b"a", b"a\n", b"\n\n\nb", bytes(rng.choice(b"ab\n\xff") for _ in range(400))):
        (tmp_path / "f").write_bytes(data)
        want = data.decode("latin-1").split("\n")
        want = want[:-1] if want[-1] == "" else want
        for step in (1, 2, 7, 1000):
            ranges = [(str(tmp_path / "f"), at, min(at + step, len(data))) for at in range(0, len(data), step)]
            found = corpus._lines_of_ranges(iter([pd.DataFrame(ranges, columns=["path", "first", "last"])]))
            assert [line for part in found for line in part.line] == want
