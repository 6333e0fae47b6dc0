"""Quality rules: a threshold table compiled into one Spark projection.

The table's rows name a measure, a comparison and a limit; ``compile_rules``
turns them into one boolean expression over measures that are themselves
built-in expressions, so nothing but the JVM sees a text and nothing shuffles.

Defined results: a null or empty text, or one of white space only, has no words,
all its measures are 0 and the base rule rejects it.  Equal rows get equal rows.
An empty table gives an empty table.  Other columns pass through; a column with
the name of a measure is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_CLASS, let, quoted, without

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Frequent words of the languages that the rules know.
STOP_WORDS = tuple(
    sorted(
        set(
            "the of and to in is that it for was on are as with be by at this from or an a "
            "der die und das ist ein eine nicht zu den von mit im auf für dem sich des auch es "
            "le la les de et des un une que en est pour dans qui par sur avec il elle au "
            "el los las y que una por con para se del no su al lo como "
            "il di che non per sono del della een het van dat niet os as um uma em não och att som".split()
        )
    )
)


@dataclass(frozen=True)
class Rule:
    """A document fails where ``measure op limit`` does not hold.

    ``per``: the measure is compared as a share of another one, without division.
    """

    name: str
    measure: str
    op: str
    limit: float
    per: str | None = None


#: The production table.  Limits follow the usual web-corpus heuristics, but lean
#: to keeping: a stop word in a hundred words is enough.
RULES = (
    Rule("words_at_most", "n_words", "<=", 10_000_000),
    Rule("mean_word_at_least", "word_chars", ">=", 1.5, per="n_words"),
    Rule("mean_word_at_most", "word_chars", "<=", 25, per="n_words"),
    Rule("symbols_per_word", "n_symbols", "<=", 0.25, per="n_words"),
    Rule("duplicate_lines", "n_dup_lines", "<=", 0.5, per="n_lines"),
    Rule("stop_words_per_word", "n_stop_words", ">=", 0.01, per="n_words"),
)


def _words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(bare) > 0, F.split(bare, SPACE_CLASS + "+")).otherwise(F.array().cast("array<string>"))


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight that occur twice or more in the text.

    Window hashes are built by doubling (1, 2, 4, 8 words).  Only texts whose
    hashes are not all distinct pay for the sort that finds the positions.
    """

    def positions(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(
            ordered,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(
                        s,
                        lambda e, k: ((k > 0) & (F.get(s, k - 1)["h"] == e["h"]))
                        | F.coalesce(F.get(s, k + 1)["h"] == e["h"], F.lit(False)),
                    ),
                    lambda e: e["i"],
                )
            ),
        )

    def covered(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct(
                (i + WINDOW).alias("end"), (acc["n"] + (i + WINDOW - F.greatest(acc["end"], i))).alias("n")
            ),
            lambda acc: acc["n"],
        )

    def doubled(hashes: Column, step: int) -> Column:
        """Hashes of twice as many words: of i and of i + step."""
        return let(
            hashes,
            lambda a: F.transform(
                F.slice(a, F.lit(1), F.greatest(F.size(a) - step, F.lit(0))),
                lambda h, i: F.xxhash64(h, F.get(a, i + step)),
            ),
        )

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        hashes = doubled(hashes, step)
    return F.when(
        F.size(words) > WINDOW,
        let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(positions(h))).otherwise(
                F.lit(0).cast("long")
            ),
        ),
    ).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """A struct of all measures of a text."""
    known = [w + end for w in STOP_WORDS for end in ("", ",", ".")]

    def of(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            _repeat_words(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(known))).cast("long").alias("n_stop_words"),
        )

    return let(_words(F.coalesce(text, F.lit(""))), of)


def line_measures(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: F.length(F.btrim(line, F.lit(SPACE_CHARS))) > 0)
    return let(
        lines,
        lambda a: F.struct(
            F.size(a).cast("long").alias("n_lines"),
            (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        ),
    )


def compile_rules(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The verdict (boolean) and the names of the failed rules (array) as expressions over the measures."""
    ops = {"<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}
    failed, passes = [], F.lit(True)
    for rule in rules:
        limit = F.lit(float(rule.limit))
        bound = limit * F.col(rule.per) if rule.per else limit
        holds = ops[rule.op](F.col(rule.measure).cast("double"), bound)
        passes = passes & holds
        failed.append(F.when(~holds, F.lit(rule.name)))
    return passes, F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")


def apply_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``kept`` and ``failed_rules``."""
    names = (*BASE_MEASURES, "n_stop_words", "n_lines", "base_failed", "kept", "failed_rules")
    text = quoted(text_col)
    wide = docs.withColumn("__gm_m", measures(text)).withColumn("__gm_l", line_measures(text))
    passes, failed = compile_rules(rules)
    n, rep = F.col("n_words"), F.col("n_repeat_words")
    base = (n < MIN_WORDS) | (F.lit(100) * rep > F.lit(MAX_REPEAT_PERCENT) * n)
    inner = {m: F.col(f"__gm_{'l' if m in ('n_lines', 'n_dup_lines') else 'm'}.{m}") for m in names[:7]}
    flat = without(wide, names)
    flat = flat.select(
        *[quoted(c) for c in flat.columns if c not in ("__gm_m", "__gm_l")], *[c.alias(m) for m, c in inner.items()]
    )
    return flat.withColumns({"base_failed": base}).withColumns(
        {"kept": ~F.col("base_failed") & passes, "failed_rules": failed}
    )


def keep(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns only."""
    names = {m.lower() for m in (*BASE_MEASURES, "n_stop_words", "n_lines", "base_failed", "kept", "failed_rules")}
    clash = [c for c in docs.columns if c.lower() in names]
    away = docs.select(*[quoted(c).alias(f"__gm_own_{c}") if c in clash else quoted(c) for c in docs.columns])
    source = f"__gm_own_{text_col}" if text_col in clash else text_col
    kept = apply_rules(away, source, rules).filter("kept")
    return kept.select(*[quoted(f"__gm_own_{c}" if c in clash else c).alias(c) for c in docs.columns])
