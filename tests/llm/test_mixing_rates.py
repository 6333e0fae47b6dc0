"""Sources whose rate is far above those of the others."""

import math

import pytest

from glyphmill.llm import mixing


@pytest.mark.parametrize("rate", [64.5, 94.0, 800.0, 1e6])
def test_tables_are_those_of_the_distribution(rate):
    table, first = mixing.poisson_table(rate), mixing.first_step(rate)
    p = [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(first, first + len(table))]
    total = 0.0
    for got, each in zip(table, p):
        total += each
        assert got == pytest.approx(total, abs=1e-7)
    assert table[0] < 1e-12 and table[-1] == pytest.approx(1.0, abs=1e-12)


def test_a_small_source_gets_its_copies(spark):
    rows = [(i, "x" * 2_000_000, f"s{i % 20}") for i in range(20)] + [(100, "a", "tiny"), (101, "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rates = {r.source: r.rate for r in mixing.source_rates(docs, "source", "text").collect()}
    assert rates["tiny"] == rates[None] > mixing.MAX_RATE
    found = mixing.mix(docs).select("doc_id", "n_copies", "copy_no").collect()
    for i in (100, 101):
        mine = [r for r in found if r.doc_id == i]
        assert sorted(r.copy_no for r in mine) == list(range(mine[0].n_copies))
        assert abs(len(mine) - rates[None]) < 6 * math.sqrt(rates[None])


def test_blocks_of_copies_join(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b" * 400_000, "y")], "doc_id long, text string, source string")
    found = mixing.mix(docs, weights={"x": 0.6, "y": 0.4}).filter("doc_id = 1")
    first = found.first()
    assert first.n_copies > mixing.BLOCK and abs(first.n_copies - first.rate) < 6 * math.sqrt(first.rate)
    assert found.count() == found.select("copy_no").distinct().count() == first.n_copies
