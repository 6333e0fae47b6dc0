"""CSV tables, vectors, whole runs, the stream."""

import math
import random

import pytest
from pyspark.sql import functions as F

from glyphmill import queries as Q
from glyphmill.config import Settings
from glyphmill.functions import vectors as V
from glyphmill.operators import vectors as E
from glyphmill.plans import model as M
from glyphmill.sources import tables as B
from glyphmill.streaming import counts as ST


def lines(tmp_path, *rows):
    path = tmp_path / "t.csv"
    path.write_text("\n".join(rows) + "\n")
    return str(path)


def test_matrix(spark, tmp_path):
    path = lines(tmp_path, "1,2,", "", "x, 2.5 ,3", '"4",5')
    assert [r["values"] for r in B.read_matrix(spark, path).orderBy("row").collect()] == [[1, 2], [0, 2.5, 3], [4, 5]]


def test_columns(spark, tmp_path):
    path = lines(tmp_path, '"a""b",1', "  c ", '",",2,z')
    assert [r.token for r in B.read_first_column(spark, path).collect()] == ['a"b', "c", ","]
    assert [r.value for r in B.read_column(spark, path, 1).collect()] == ["1", "", "2"]
    assert B.read_column(spark, path, -1).isEmpty()


def test_counts_of_tokens(spark, tmp_path):
    path = lines(tmp_path, "a,1", "b,12abc", "c,abc", "a,3", '"""",7', "',8")
    assert {r.token: r.cnt for r in B.read_token_counts(spark, path).collect()} == {"a": 3, "b": 12, '"': 7, "'": 8}


def test_token_vectors(spark, tmp_path):
    path = lines(tmp_path, "a,1,2,", ",3,4", "b,x,1", "a,5,6")
    assert {r.token: r.embedding for r in B.read_token_vectors(spark, path).collect()} == {"a": [5, 6]}


def plain_fields(line):
    """The fields of a line, character by character."""
    out, at = [], 0
    while at < len(line):
        while at < len(line) and line[at].isspace():
            at += 1
        held = ""
        if line[at : at + 1] == '"':
            at += 1
            while at < len(line):
                if line[at] == '"':
                    at += 1
                    if line[at : at + 1] != '"':
                        break
                held += line[at]
                at += 1
            while at < len(line) and line[at].isspace():
                at += 1
            at += line[at : at + 1] == ","
        else:
            end = line.find(",", at)
            end = len(line) if end < 0 else end
            held, at = line[at:end], end + 1
        out.append(held)
    return out


def bare(field):
    field = field.strip(" \t\r\n")
    if len(field) >= 2 and field[0] == field[-1] and field[0] in "'\"":
        return field[1:-1].replace('""', '"') if field[0] == '"' else field[1:-1]
    return field


def test_fields_equal_a_plain_reader(spark, tmp_path):
    rng = random.Random(5)
    rows = ["".join(rng.choice(['"', '""', ",", " ", "a", "'", "1", "\t", 'x"', ", "]) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    rows = [r for r in rows if r.strip(" \t")]
    path = lines(tmp_path, *rows)
    got = [r.cells for r in B.read_cells(spark, path).orderBy("at").collect()]
    for row, cells in zip(rows, got, strict=True):
        assert cells == [bare(f) for f in plain_fields(row.strip(" \t\r\n"))], repr(row)


def test_blanks_behind_quotes(spark, tmp_path):
    path = lines(tmp_path, '"a" ,7', '"c,d" ,8', "'x',9", '"y"z,3', ' "q" , "12" ')
    assert {r.token: r.cnt for r in B.read_token_counts(spark, path).collect()} == {"a": 7, "c,d": 8, "x": 9, "q": 12}


def test_long_fields(spark, tmp_path):
    path = lines(tmp_path, '"' + "x" * 1_000_000 + '",1', '"a' + '""' * 300_000 + '",2', "y" * 500_000 + ",3", "z,4")
    assert {len(r.token): r.cnt for r in B.read_token_counts(spark, path).collect()} == {1_000_000: 1, 300_001: 2, 500_000: 3, 1: 4}


def test_numbers_by_their_beginning(spark, tmp_path):
    path = lines(tmp_path, "1.5abc,2e1x,.5,-3.,1e99,x1,,inf", "7")
    assert [r["values"] for r in B.read_matrix(spark, path).orderBy("row").collect()] == [[1.5, 20, 0.5, -3, 0, 0, 0, math.inf], [7]]


def test_empty_fields_of_vectors(spark, tmp_path):
    path = lines(tmp_path, "a,,,3", "b,,3", "c,1,,,", "d,", "e", "f,1,", "g,1,,2", "h,1e99", 'i,"1.5x" ,2', 'j,"",,4', "k,1,,")
    want = {"a": [0, 3], "c": [1, 0, 0], "d": [0], "f": [1], "i": [1.5, 2], "j": [0, 4]}
    assert {r.token: r.embedding for r in B.read_token_vectors(spark, path).collect()} == want


def test_last_line_wins_over_files(spark, tmp_path):
    for k in range(4):
        (tmp_path / f"part-{k}.csv").write_text(f"a,{k}\n" + "b,1\n" * (1 if k == 3 else 2000))
    assert {r.token: r.cnt for r in B.read_token_counts(spark, str(tmp_path)).collect()} == {"a": 3, "b": 1}


def test_ranks(spark):
    rows = B.ranked(spark.createDataFrame([("b",), ("a",), ("abc",), ("",), ("a",)], "token string"))
    assert [(r["rank"], r.token, r.len) for r in rows.orderBy("rank").collect()] == [(0, "abc", 3), (1, "a", 1), (2, "b", 1)]


def test_coefficients(spark):
    at = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (2, 5)], "i int, j int")
    got = [r[0] for r in at.select(V.coefficient(F.col("i"), F.col("j"))).collect()]
    assert got == pytest.approx([1.381773, 1.841471, 1.449600, -0.512524], abs=1e-6)


def test_vectors_lie_on_their_lattice(spark):
    vocabulary = spark.createDataFrame([(k, f"t{k}", 2) for k in range(200)], "rank int, token string, len int")
    settings = Settings(dim=8, lam=1.05)
    rows = E.vocabulary_vectors(vocabulary, settings).collect()
    draws = []
    for r in rows:
        for j, v in enumerate(r.embedding):
            c = math.sin(r["rank"] + 1) + math.cos(j - 1)
            if abs(c) > 0.05:
                k = (v - 0.01) / (0.1 * c)
                assert abs(k - round(k)) < 1e-3 and round(k) >= 0
                draws.append(round(k))
    assert abs(sum(draws) / len(draws) - 1.05) < 0.1
    again = E.vocabulary_vectors(vocabulary.repartition(7), settings).collect()
    assert {r.token: r.embedding for r in rows} == {r.token: r.embedding for r in again}


def test_inverse(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],)], "v array<float>")
    got = [r[0] for r in rows.select(V.inverse(F.col("v"))).collect()]
    assert got[0] == pytest.approx([0.12, 0.16]) and got[1] == [0, 0] and got[2] == []
    assert all(math.isnan(x) for x in rows.select(V.inverse(F.col("v"), guard=False)).collect()[1][0])


def test_xorshift(spark):
    got = [r[0] for r in spark.createDataFrame([(1,), (2,), (12345,)], "x long").select(V.xorshift32(F.col("x"))).collect()]
    assert got == [270369, 540738, 3336926330]


def test_lookup_and_replacement(spark):
    vectors = spark.createDataFrame([(0, "a", [1.0]), (1, "b", [2.0])], "rank int, token string, embedding array<float>")
    keys = spark.createDataFrame([("a",), ("z",)], "token string")
    assert {r.token: r.embedding for r in E.look_up(keys, vectors).collect()} == {"a": [1.0], "z": []}
    changes = spark.createDataFrame([("b", [9.0]), ("z", [8.0])], "token string, embedding array<float>")
    assert {r.token: r.embedding for r in E.replace_vectors(vectors, changes).collect()} == {"a": [1.0], "b": [9.0]}
    assert E.at_rank(vectors, 1).first().token == "b"


def test_train_save_load_segment(spark, tmp_path):
    corpus = tmp_path / "in"
    corpus.mkdir()
    (corpus / "a.txt").write_text('low low lower, newest\nwidest "newest" newest\n')
    made = M.train(spark, str(corpus), str(tmp_path / "out"), Settings(num_merges=8, dim=4))
    loaded = M.load(spark, str(tmp_path / "out"))
    ranks = lambda m: [(r["rank"], r.token) for r in m.vocabulary.orderBy("rank").collect()]
    assert ranks(made) == ranks(loaded) and made.size == loaded.size
    assert made.strays().isEmpty()
    assert {r.token: r.cnt for r in made.stats.collect()} == {r.token: r.cnt for r in loaded.stats.collect()}
    rows = spark.createDataFrame([("Newest low.",)], "text string")
    assert made.segment(rows).first().tokens == loaded.segment(rows).first().tokens
    saved = B.read_matrix(spark, str(tmp_path / "out" / "embeddings_only"))
    assert saved.count() == made.size and {len(r["values"]) for r in saved.collect()} == {4}
    assert made.inverse_vectors().count() == made.size


def test_stream_counts_like_a_batch(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one two\nTwo\n")
    places = (str(tmp_path / "counts"), str(tmp_path / "state"))
    ST.stream_batches(spark, str(folder), *places)
    (folder / "b.txt").write_text("two\n")
    ST.stream_batches(spark, str(folder), *places)
    assert {r.token: r.cnt for r in ST.total(spark, places[0]).collect()} == {"one": 1, "two": 3, "</s>": 3}


def test_text_files_have_the_lines_of_the_texts(spark, tmp_path):
    texts = ["a b", None, "", "x\n", "\n", "q\r\nw\rz", "fooBar\n\n", "\nz"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = {r.token: r.cnt for r in Q.stream_word_counts(spark, str(tmp_path)).collect()}
    assert counts == {r.token: r.cnt for r in Q.word_counts(spark, str(tmp_path)).collect()} and counts["</s>"] == 9
