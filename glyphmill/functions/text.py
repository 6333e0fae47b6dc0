"""Byte-exact lexing and small text functions, all as built-in expressions.

Text is seen as bytes: ``byte_view`` gives a string with one character for each
byte of the UTF-8 form, on which character classes and order are those of bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LINE_END, WORD_END

#: Runs of ASCII letters; any other byte that isn't ASCII white space is a token of its own.
TOKEN = r"([A-Za-z]+|[^A-Za-z\s])"
CAMEL = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
BLANKS = " \t\r\n"


def byte_view(text: Column) -> Column:
    return F.decode(text.cast("binary"), "ISO-8859-1")


def raw_tokens(text: Column, is_bytes: bool = False) -> Column:
    """Letter runs and single bytes of a text (or of a byte view), in order; none for null."""
    view = text if is_bytes else byte_view(text)
    return F.coalesce(F.regexp_extract_all(view, F.lit(TOKEN), 1), F.array().cast("array<string>"))


def line_count(text: Column) -> Column:
    """Lines of a text as one file: a last line counts without its end, a final end adds none."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    open_end = F.when((F.length(text) > 0) & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)
    return F.coalesce(ends + open_end, F.lit(0))


def starts_with_letter(token: Column) -> Column:
    return token.rlike("^[A-Za-z]")


def is_merge_candidate(token: Column) -> Column:
    """What the learner calls a word: a letter first and more than one byte."""
    return starts_with_letter(token) & (F.length(token) > 1)


def camel_pieces(word: Column) -> Column:
    """A letter run split where case shows a boundary, case kept."""
    return F.when(F.length(word) > 0, F.split(word, CAMEL)).otherwise(F.array().cast("array<string>"))


def training_tokens(raw: Column) -> Column:
    """A raw token as the counted tokens: letter runs split and lower-cased, others as they are."""
    return F.when(starts_with_letter(raw), F.transform(camel_pieces(raw), lambda p: F.lower(p))).otherwise(F.array(raw))


def symbols(word: Column) -> Column:
    """The first symbols of a word: its characters and the end mark."""
    return F.array_append(F.split(word, "", -1), F.lit(WORD_END))


def adjacent_pairs(parts: Column) -> Column:
    """(left, right) for each neighbouring pair of an array."""
    lefts = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.transform(lefts, lambda x, i: F.struct(x.alias("left"), F.get(parts, i + 1).alias("right")))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def unquoted(text: Column) -> Column:
    """Without outer quotes: doubled quotes inside double ones become single, single quotes just go."""
    inner = F.substring(text, F.lit(2), F.length(text) - 2)

    def wrapped(mark: str) -> Column:
        return (F.length(text) >= 2) & F.startswith(text, F.lit(mark)) & F.endswith(text, F.lit(mark))

    return F.when(wrapped('"'), F.replace(inner, F.lit('""'), F.lit('"'))).when(wrapped("'"), inner).otherwise(text)


def csv_field(text: Column) -> Column:
    """Quoted where it must be: empty, blank throughout, or with a comma, a quote or a line end."""
    must = (F.length(trimmed(text)) == 0) | text.rlike('[,"\r\n]')
    return F.when(must, F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_always_quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def looks_like_header(line: Column) -> Column:
    """A line that names columns: token or word with count, token with repetitions, or embedding."""
    low = F.lower(trimmed(line))

    def has(word: str) -> Column:
        return F.contains(low, F.lit(word))

    return (has("token") & (has("count") | has("repetitions"))) | (has("word") & has("count")) | has("embedding")


def with_line_ends(text: Column, is_bytes: bool = False) -> Column:
    """Raw tokens of a text as one file, with a line-end token for each of its lines."""
    return F.concat(raw_tokens(text, is_bytes), F.array_repeat(F.lit(LINE_END), line_count(text).cast("int")))
