"""Corpora: folders of text files, or tables with one text to a row."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import line_count

CHUNK = 1 << 22
#: Bytes of a file that one task of the reader for odd names begins with.
RANGE = 64 << 20
#: Inputs of fewer bytes are spread over all cores.
SMALL = 256 << 20
#: Names that Spark's text source leaves out, or whose content it would decompress.
_ODD = re.compile(r"(?i)^[._]|\.(?:gz|gzip|bz2|deflate|lz4|snappy|zst|xz)$")


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(path, line) of every regular file directly in a folder, whatever its name; lines end at \\n only.

    Lines are byte views: one character for each byte as it is in the file.
    Files with common names are read by Spark's text source, by splits; hidden
    and compressed names, which that source treats in its own way, by a reader
    of byte ranges.
    """
    files = sized_files(spark, folder)
    if not files:
        raise FileNotFoundError(f"no files in {folder}")
    odd = [f for f in files if _ODD.search(f[0].rpartition("/")[2])]
    plain = [f[0] for f in files if f not in odd]
    parts = []
    if plain:
        rows = spark.read.option("lineSep", "\n").text(plain)
        view = F.decode(F.col("value").cast("binary"), "ISO-8859-1")
        parts.append(rows.select(F.col("_metadata.file_path").alias("path"), view.alias("line")))
    if odd:
        ranges = [(f, at, min(at + RANGE, n)) for f, n in odd for at in range(0, n, RANGE)]
        table = spark.createDataFrame(ranges, "path string, first long, last long").repartition(max(1, min(len(ranges), 1000)))
        parts.append(table.mapInPandas(_lines_of_ranges, "path string, line string"))
    return parts[0] if len(parts) == 1 else parts[0].union(parts[1])


def _lines_of_ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines that begin in each range of bytes."""
    from pyarrow import fs

    for batch in batches:
        for path, first, last in zip(batch.path, batch["first"], batch["last"]):
            bare = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
            system, where = (fs.LocalFileSystem(), bare) if bare.startswith("/") else fs.FileSystem.from_uri(bare)
            with system.open_input_file(where) as stream:
                # the byte before the range tells whether a line begins with it
                pos, skip, left = max(int(first) - 1, 0), first > 0, b""
                stream.seek(pos)
                while pos < last:
                    chunk = stream.read(CHUNK)
                    *whole, left = (left + chunk).split(b"\n")
                    if not chunk and left:
                        whole, left = [left], b""
                    lines = []
                    for line in whole:
                        if not skip and pos < last:
                            lines.append(line.decode("latin-1"))
                        skip, pos = False, pos + len(line) + 1
                    yield pd.DataFrame({"path": path, "line": lines})
                    if not chunk:
                        break


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Regular files directly in a folder, of any extension, hidden ones too."""
    return [path for path, _ in sized_files(spark, folder)]


def sized_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the regular files directly in a folder, by path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted((s.getPath().toString(), int(s.getLen())) for s in fs.listStatus(at) if s.isFile())


def texts_of_lines(lines: DataFrame) -> DataFrame:
    """Lines as texts whose line ends are kept, so that counting sees the same lines."""
    return lines.select(F.concat("line", F.lit("\n")).alias("text"))


def spread(rows: DataFrame, least: int = SMALL) -> DataFrame:
    """``rows`` over all cores if the plan's estimate of their size is small.

    A small file may be one row group and so one task, however many cores there
    are; larger inputs have splits enough and are left where they are.
    """
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > least:
        return rows
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def texts_of_table(table: DataFrame, column: str = "text") -> DataFrame:
    """One text to a row, each as one file."""
    return spread(table.select(F.col(column).alias("text")))


def lines_of_table(table: DataFrame, column: str = "text") -> DataFrame:
    """The lines of each text; a final line end adds none, an empty text has none."""
    text = F.col(column)
    cut = F.when(F.endswith(text, F.lit("\n")), F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    return table.filter(F.length(text) > 0).select(F.explode(F.split(cut, "\n", -1)).alias("line"))


def count_lines(texts: DataFrame) -> DataFrame:
    return texts.agg(F.coalesce(F.sum(line_count(F.col("text"))), F.lit(0)).cast("long").alias("n_lines"))


def count_file_lines(spark: SparkSession, path: str) -> int:
    """Lines of one file; -1 if it can't be read."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.option("lineSep", "\n").text(path).count()
    except AnalysisException:
        return -1


def corpus_bytes(spark: SparkSession, folder: str) -> int:
    """Bytes of all files of a folder: what progress is measured against."""
    found = spark.read.format("binaryFile").load(folder).agg(F.sum("length")).first()
    return int(found[0] or 0)
