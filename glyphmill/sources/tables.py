"""Headerless CSV tables of the model: readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import csv_always_quoted, csv_field, trimmed, unquoted

#: A quoted run up to its closing quote or the line's end; possessive, so that its length costs no stack.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+(?:"\s*+,?|\z)'
#: One field with its comma.  What follows a closing quote directly is a field of its own.
_FIELD = rf'\s*+(?:{_QUOTED}|[^",][^,]*+(?:,|\z)|,)'
#: In rows of vectors an empty field that another comma follows takes that comma too.
_NUMBER_FIELD = rf'\s*+(?:(?:""\s*+)?,,|{_QUOTED}|[^",][^,]*+(?:,|\z)|,)'
#: What \s stands for in a pattern.
SPACE = " \t\n\x0b\f\r"
_FLOAT = r'^\s*([+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf(?:inity)?|nan)))'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that aren't blank, trimmed, with their place: file, split, row."""
    raw = spark.read.option("lineSep", "\n").text(path)
    place = F.struct(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
    )
    return raw.select(trimmed(F.col("value")).alias("line"), place.alias("at")).filter(F.length("line") > 0)


def _content(field: Column) -> Column:
    """What a field holds, as it stands: without its comma, its quotes and the blanks before it."""
    return _of_bare(_bare(field))


def _bare(field: Column) -> Column:
    return F.ltrim(field, F.lit(SPACE))


def _of_bare(bare: Column) -> Column:
    inner = F.replace(F.regexp_extract(bare, r'^"([^"]*+(?:""[^"]*+)*+)', 1), F.lit('""'), F.lit('"'))
    plain = F.when(F.endswith(bare, F.lit(",")), F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)
    return F.when(F.startswith(bare, F.lit('"')), inner).otherwise(plain)


def _cells(fields: Column) -> Column:
    """Fields as the readers use them: trimmed, then without outer quotes.

    One step to a pass: a step names its input several times, and nested steps
    would be evaluated anew for each of them.
    """
    contents = F.transform(F.transform(fields, _bare), _of_bare)
    return F.transform(F.transform(contents, trimmed), unquoted)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(at, cells): lines as arrays of fields: blanks before a field and behind a closing quote are skipped, a trailing comma adds none."""
    cells = _cells(F.regexp_extract_all("line", F.lit(_FIELD), 0))
    return _lines(spark, path).select("at", cells.alias("cells"))


def leading_number(text: Column) -> Column:
    """The decimal number that a text begins with; null without one, or beyond the range of a float."""
    found = F.regexp_extract(text, _FLOAT, 1)
    value = found.try_cast("float")
    endless = (F.abs(value) == F.lit(float("inf"))) & ~found.rlike("(?i)inf")
    return F.when(~endless, value)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(row, values): floats, by the number that a field begins with; a field without one is 0."""
    values = F.transform("cells", lambda c: F.coalesce(leading_number(c), F.lit(0.0).cast("float")))
    return read_cells(spark, path).select(F.col("at").alias("row"), values.alias("values"))


def read_first_column(spark: SparkSession, path: str) -> DataFrame:
    return read_cells(spark, path).select(F.coalesce(F.get("cells", F.lit(0)), F.lit("")).alias("token"))


def read_column(spark: SparkSession, path: str, index: int) -> DataFrame:
    """The field at an index from 0; empty where a line is shorter, nothing for a negative index."""
    cells = read_cells(spark, path)
    if index < 0:
        cells = cells.filter(F.lit(False))
    return cells.select(F.coalesce(F.get("cells", F.lit(index)), F.lit("")).alias("value"))


def read_token_counts(spark: SparkSession, path: str) -> DataFrame:
    """(token, cnt): the leading number of the second field; lines without one go; the last line of a token wins."""
    number = F.regexp_extract(F.get("cells", F.lit(1)), r"^\s*([+-]?\d+)", 1)
    rows = read_cells(spark, path).select(
        F.get("cells", F.lit(0)).alias("token"), number.try_cast("long").alias("cnt"), "at"
    )
    kept = rows.filter("token is not null and cnt is not null")
    return kept.groupBy("token").agg(F.max_by("cnt", "at").alias("cnt"))


def read_token_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(token, embedding): lines with an empty token or without numbers go, and those with a field that is none; the last line wins.

    An empty field is 0 where a further comma follows it directly (both commas
    are one separator then), and at the line's end behind such a pair or behind
    the token; elsewhere it is no number.
    """
    first = F.regexp_extract("line", "^" + _FIELD, 0)
    parts = _lines(spark, path).select("at", "line", F.get(_cells(F.array(first)), F.lit(0)).alias("token"), F.substring("line", F.length(first) + 1, F.length("line")).alias("rest"))
    found = F.regexp_extract_all("rest", F.lit(_NUMBER_FIELD), 0)
    zero = F.lit(0.0).cast("float")

    def is_pair(field: Column) -> Column:
        return field.rlike(r'^\s*(?:""\s*)?,,$')

    values = F.transform(found, lambda f: F.when(is_pair(f), zero).otherwise(leading_number(trimmed(unquoted(_content(f))))))
    one_more = F.when(F.length("rest") == 0, F.endswith("line", F.lit(","))).otherwise(is_pair(F.element_at(found, -1)))
    made = parts.select("at", "token", F.when(one_more, F.concat(values, F.array(zero))).otherwise(values).alias("embedding"))
    good = made.filter(F.length("token") > 0).filter(F.size("embedding") > 0).filter(~F.exists("embedding", lambda x: x.isNull()))
    return good.groupBy("token").agg(F.max_by("embedding", "at").alias("embedding"))


def ranked(tokens: DataFrame) -> DataFrame:
    """(rank, token, len): longest first, then by bytes.

    Ranks come from counts of shorter groups: a window over lengths, which are
    few, plus one over the tokens of a length.
    """
    sized = tokens.filter(F.length("token") > 0).select("token", F.length("token").alias("len")).distinct()
    longer = Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.groupBy("len").count().select("len", F.coalesce(F.sum("count").over(longer), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("len").orderBy("token")) - 1
    numbered = sized.withColumn("inside", inside).join(F.broadcast(offsets), "len")
    return numbered.select((F.col("before") + F.col("inside")).cast("int").alias("rank"), "token", "len")


def load_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """(rank, token, len) from the token statistics of a folder."""
    return ranked(read_token_counts(spark, f"{folder}/final_token_stats"))


def write_unique_tokens(counts: DataFrame, path: str) -> None:
    """One quoted token to a line; an empty path writes nothing."""
    if path:
        counts.select(csv_always_quoted(F.col("token")).alias("value")).write.mode("overwrite").text(path)


def write_token_stats(stats: DataFrame, path: str) -> None:
    """token,count by token; parts are in order."""
    line = F.concat_ws(",", csv_field(F.col("token")), F.col("cnt").cast("string"))
    stats.orderBy("token").select(line.alias("value")).write.mode("overwrite").text(path)


def write_vectors(vectors: DataFrame, path: str, with_token: bool = False) -> None:
    """A line of floats to a row, by rank, with the trailing comma of the format."""
    floats = F.concat(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), F.lit(","))
    line = F.concat(csv_field(F.col("token")), F.lit(","), floats) if with_token else floats
    vectors.orderBy("rank").select(line.alias("value")).write.mode("overwrite").text(path)
