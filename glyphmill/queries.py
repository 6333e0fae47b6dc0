"""Queries over the engine's operators; each takes (spark, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions import text as T
from .functions import vectors as V
from .operators import counts as C
from .operators import learn as L
from .operators import segment as S
from .operators import vectors as E
from .plans.model import load, train
from .sources import corpus, tables
from .sources.shared import own_path
from .streaming.counts import stream_batches, total

#: Merges that the SQL side unrolls; both semantics agree on them at the tested size.
K = 16
#: A longer run of the sequential learner.
LONG = 2_000
DIM, LAM, SEED = 16, 1.05, 42


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.texts_of_table(_read(spark, sf_dir, "documents"))


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.word_counts(_texts(spark, sf_dir))


def _kept(df: DataFrame, label: str) -> DataFrame:
    """As a table, for what is used several times."""
    path = own_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _kept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(_counts(spark, sf_dir), "counts")


def _canonical(counts: DataFrame, merges: int = K) -> DataFrame:
    return L.learn_merges(counts, Settings(num_merges=merges, semantics="canonical"))


def _learned(spark: SparkSession, sf_dir: str, merges: int = K) -> tuple[DataFrame, DataFrame]:
    """Counts and ranked vocabulary after some merges."""
    counts = _kept_counts(spark, sf_dir)
    tokens = _kept(L.vocabulary_tokens(counts, _canonical(counts, merges)), "tokens")
    return counts, _kept(tables.ranked(tokens), "vocabulary")


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.count_lines(_texts(spark, sf_dir))


def merged_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two corpora as one."""
    other = C.word_counts(corpus.texts_of_table(_read(spark, sf_dir, "conversations")))
    return C.merge_counts(_counts(spark, sf_dir), other)


def camel_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = C.raw_counts(corpus.texts_of_table(_read(spark, sf_dir, "pages"), "html"))
    words = raw.filter(T.starts_with_letter(F.col("raw")))
    return words.select(F.col("raw").alias("word"), F.array_join(T.camel_pieces(F.col("raw")), "|").alias("pieces"), "cnt")


def unique_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).select("token")


def atomic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.atomic_tokens(_counts(spark, sf_dir))


def bpe_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merge_candidates(_counts(spark, sf_dir))


def base_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.base_vocabulary(_kept_counts(spark, sf_dir))


def initial_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.initial_splits(_counts(spark, sf_dir)).select("word", "freq", F.array_join("symbols", " ").alias("symbols"))


def pair_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pair_stats(C.initial_splits(_counts(spark, sf_dir)))


def pair_index_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = C.pair_index(C.initial_splits(_counts(spark, sf_dir)))
    return index.groupBy("left", "right").agg(F.count(F.lit(1)).alias("n_words"), F.sum("times").alias("n_entries"))


def best_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.best_pair(pair_stats(spark, sf_dir))


def bpe_merges_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _canonical(_kept_counts(spark, sf_dir))


def bpe_merges_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same merges, learned in distributed rounds."""
    return L.distributed_merges(_counts(spark, sf_dir), K)


def bpe_merges_literal_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The literal learner, as far as both semantics agree."""
    return L.replay_merges(_counts(spark, sf_dir), K, "literal")


def bpe_merges_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.replay_merges(_counts(spark, sf_dir), LONG, "literal")


def vocabulary_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _learned(spark, sf_dir)[1]


def segment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, vocabulary = _learned(spark, sf_dir)
    words = C.merge_candidates(counts).select(F.col("token").alias("word"))
    return S.segment_words(words, vocabulary).select("word", F.array_join("pieces", " ").alias("pieces"))


def segment_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, vocabulary = _learned(spark, sf_dir)
    both = _read(spark, sf_dir, "conversations").select(F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("id"), "text").union(
        _read(spark, sf_dir, "benchmark").select(F.concat_ws("-", F.lit("b"), "item_id").alias("id"), "text")
    )
    found = S.segment_sentences(both, vocabulary)
    return found.select("id", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts, vocabulary = _learned(spark, sf_dir)
    return S.token_stats(counts, vocabulary)


def vocabulary_strays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of another corpus that a vocabulary of the first one lacks."""
    _, vocabulary = _learned(spark, sf_dir)
    other = C.word_counts(corpus.texts_of_table(_read(spark, sf_dir, "pages"), "html"))
    return S.strays(S.token_stats(other, vocabulary), vocabulary)


def token_stats_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token statistics written as text and read back."""
    path = own_path(spark, "stats")
    tables.write_token_stats(token_stats(spark, sf_dir), path)
    return tables.read_token_counts(spark, path)


def unique_tokens_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = own_path(spark, "tokens")
    tables.write_unique_tokens(_counts(spark, sf_dir), path)
    return tables.read_first_column(spark, path)


def _base_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.ranked(_kept(base_vocabulary(spark, sf_dir), "tokens"))


def embedding_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _base_ranked(spark, sf_dir).select("rank", F.explode(F.sequence(F.lit(0), F.lit(DIM - 1))).alias("j"))
    return rows.withColumn("coefficient", F.round(V.coefficient(F.col("rank"), F.col("j")), 6))


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = E.vocabulary_vectors(_base_ranked(spark, sf_dir), Settings(dim=DIM, lam=LAM, seed=SEED))
    long = made.select("rank", "token", F.posexplode("embedding").alias("j", "value"))
    return long.withColumn("value", F.round(F.col("value").cast("double"), 5))


def token_vectors_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as headerless text with their tokens, and read back."""
    path = own_path(spark, "vectors")
    made = E.vocabulary_vectors(_base_ranked(spark, sf_dir), Settings(dim=DIM, lam=LAM, seed=SEED))
    tables.write_vectors(made, path, with_token=True)
    long = tables.read_token_vectors(spark, path).select("token", F.posexplode("embedding").alias("j", "value"))
    return long.withColumn("value", F.round(F.col("value").cast("double"), 5))


def xorshift_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _read(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("seed"))
    state = ids.withColumn("state", V.xorshift32(F.col("seed")))
    return state.withColumn("value", F.round(V.scaled(F.col("state"), 1.05), 9))


def vector_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _read(spark, sf_dir, "embeddings").select("vec_id", V.inverse(F.col("embedding")).alias("v"))
    long = made.select("vec_id", F.posexplode("v").alias("j", "value"))
    return long.withColumn("value", F.round(F.col("value").cast("double"), 5))


def zero_vector_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inverses of scaled copies, a zero vector for every fourth id."""
    scale = F.when(F.col("vec_id") % 4 == 0, 0.0).otherwise(2.0)
    rows = _read(spark, sf_dir, "embeddings").select(
        "vec_id", F.transform("embedding", lambda x: (x * scale).cast("float")).alias("embedding")
    )
    made = E.inverted(rows)
    return made.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


def embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of asked ids; an empty one for those that have none."""
    keys = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"))
    found = E.look_up(keys, _read(spark, sf_dir, "embeddings"), "vec_id")
    return found.select("vec_id", F.size("embedding").cast("long").alias("width"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


def embedding_at_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "rank")
    return E.at_rank(rows, 7).select("rank", F.posexplode("embedding").alias("j", "value")).withColumn("value", F.round(F.col("value").cast("double"), 6))


def embedding_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third vector is negated, and changes for unknown ids are ignored."""
    old = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    moved = F.when(F.col("vec_id") % 3 == 0, F.col("vec_id")).otherwise(F.col("vec_id") + 1_000_000_000)
    changes = old.select(moved.alias("vec_id"), F.transform("embedding", lambda x: -x).alias("embedding"))
    made = E.replace_vectors(old, changes, "vec_id")
    return made.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.lines_of_table(_read(spark, sf_dir, "documents"))


def csv_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select("line", T.csv_field(F.col("line")).alias("field"))


def header_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header lines among lines of which some are made to look like one."""
    made = F.when(F.length("line") % 5 == 0, F.concat(F.lit(" Token,"), "line", F.lit(",COUNT"))).otherwise(F.col("line"))
    return _lines(spark, sf_dir).select(made.alias("line")).select("line", T.looks_like_header(F.col("line")).alias("is_header"))


def trim_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with blanks and quotes around them, trimmed and unquoted."""
    mark = F.when(F.length("line") % 3 == 0, F.lit('"')).when(F.length("line") % 3 == 1, F.lit("'")).otherwise(F.lit(""))
    made = F.concat(F.lit(" \t"), mark, F.replace("line", F.lit('"'), F.lit('""')), mark, F.lit(" \r"))
    return _lines(spark, sf_dir).select(made.alias("line")).select("line", T.unquoted(T.trimmed(F.col("line"))).alias("bare"))


def vector_matrix_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written without their tokens, read back as a matrix: sums of its rows' places don't depend on order."""
    path = own_path(spark, "matrix")
    made = E.vocabulary_vectors(_base_ranked(spark, sf_dir), Settings(dim=DIM, lam=LAM, seed=SEED))
    tables.write_vectors(made, path)
    long = tables.read_matrix(spark, path).select(F.posexplode("values").alias("j", "value"))
    return long.groupBy("j").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round(F.col("value").cast("double"), 5)), 3).alias("total"))


def stats_column_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second field of the written token statistics, and how often each value occurs."""
    path = own_path(spark, "stats")
    tables.write_token_stats(token_stats(spark, sf_dir), path)
    return tables.read_column(spark, path, 1).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def csv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines as quoted fields with blanks around, an empty one, one in single quotes and a number with a tail; read back."""
    path = own_path(spark, "fields")
    line = T.trimmed(F.col("line"))
    quoted = F.concat(F.lit(' "'), F.replace(line, F.lit('"'), F.lit('""')), F.lit('" ,'))
    rest = F.concat(F.lit(' "'), F.length(line).cast("string"), F.lit("x\" , ,'q'"), F.length(line).cast("string"), F.lit("'z, .5e1y ,"))
    made = _lines(spark, sf_dir).filter(F.length(line) > 0).select(F.concat(quoted, rest).alias("value")).distinct()
    made.write.text(path)
    cells = tables.read_cells(spark, path)
    number = tables.leading_number(F.get("cells", F.lit(4)))
    names = [F.get("cells", F.lit(k)).alias(f"c{k}") for k in range(4)]
    return cells.select(*names, number.cast("double").alias("number"), F.size("cells").cast("long").alias("n_cells"))


def _text_files(spark: SparkSession, sf_dir: str) -> str:
    """The lines of all texts in files: a final line end stays one, null and empty texts have no line."""
    path = own_path(spark, "text-files")
    _lines(spark, sf_dir).write.text(path)
    return path


def train_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary trained on text files, saved, and loaded again."""
    out = own_path(spark, "model")
    train(spark, _text_files(spark, sf_dir), out, Settings(num_merges=K, dim=4, semantics="canonical"))
    return load(spark, out).vocabulary


def stream_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts of text files, as a stream."""
    counts, state = own_path(spark, "stream-counts"), own_path(spark, "stream-state")
    stream_batches(spark, _text_files(spark, sf_dir), counts, state)
    return total(spark, counts)


QUERIES = {
    f.__name__: f
    for f in (
        word_counts, line_count, merged_counts, camel_split, unique_tokens, atomic_tokens, bpe_candidates, base_vocabulary,
        initial_symbols, pair_stats, pair_index_sizes, best_pair, bpe_merges_canonical, bpe_merges_distributed,
        bpe_merges_literal_first, bpe_merges_literal, vocabulary_ranked, segment_words, segment_sentences, token_stats,
        vocabulary_strays, token_stats_csv, unique_tokens_csv, embedding_coefficients, token_vectors, token_vectors_csv,
        xorshift_uniform, vector_inverse, zero_vector_guard, embedding_lookup, embedding_at_rank, embedding_update, csv_escape,
        header_predicate, trim_quotes, vector_matrix_csv, stats_column_csv, csv_fields, train_save_load, stream_word_counts,
    )
}
