"""Physical plans: what is read, what stays in the JVM, how often data is exchanged."""

import re

import pytest

import __spark_entry__
from glyphmill import queries as Q
from glyphmill.oracle import SQL
from glyphmill.sources import tables as B


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["word_counts", "pair_stats", "camel_split", "line_count", "initial_symbols", "csv_escape"])
def test_hot_paths_stay_in_the_jvm_and_read_one_column(spark, small, name):
    plan = plan_of(Q.QUERIES[name](spark, small))
    assert not re.search("Python|Pandas|Arrow", plan)
    assert re.findall(r"ReadSchema: struct<(\w+):string>", plan) and "lang" not in plan


def test_word_counts_exchange_only_counted_rows(spark, small):
    plan = plan_of(Q.word_counts(spark, small))
    assert plan.count("Exchange hashpartitioning") == 2 and "partial_count" in plan and "partial_sum" in plan


def test_lookup_is_one_join(spark, small):
    assert len(re.findall("Join", plan_of(Q.embedding_lookup(spark, small)))) == 1


def test_every_engine_query_has_sql_or_a_reason():
    assert set(Q.QUERIES) - set(SQL) == {"bpe_merges_literal"}
    assert set(SQL) <= set(Q.QUERIES)
    assert set(Q.QUERIES) <= set(__spark_entry__.queries()) and set(SQL) <= set(__spark_entry__.oracle_sql())


def test_entry(spark):
    rows = __spark_entry__.entry(spark).limit(3).collect()
    assert len(rows) == 3 and rows[0].cnt >= rows[1].cnt >= rows[2].cnt


def test_a_cell_is_made_with_one_pattern(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,1\n")
    plan = B.read_cells(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"regexp_\w+\(|Like", plan)) == 2 and "regexp_extract_all" in plan
