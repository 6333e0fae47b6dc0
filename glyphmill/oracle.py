"""The SQL that the queries equal, for DuckDB over the same tables."""

from __future__ import annotations

from .functions.vectors import poisson_limits
from .queries import DIM, K, LAM, SEED

_SPACE = r" \t\n\x0B\f\r"


def _bytes(column: str) -> str:
    """One character for each byte of the UTF-8 form."""
    return (
        f"array_to_string(list_transform(regexp_extract_all(hex(encode(coalesce({column}, ''))), '..'), "
        "lambda h: chr(cast('0x' || h as integer))), '')"
    )


def _lines_of(column: str) -> str:
    return f"(length({column}) - length(replace({column}, chr(10), '')) + case when length({column}) > 0 and {column} not like '%' || chr(10) then 1 else 0 end)"


def _counts(table: str = "documents", column: str = "text", name: str = "wc") -> str:
    return rf"""
{name}_raw as (
  select t, count(*)::bigint as n
  from (select unnest(regexp_extract_all({_bytes(column)}, '[A-Za-z]+|[^A-Za-z{_SPACE}]')) as t from {table}) group by t
), {name} as (
  select token, sum(n)::bigint as cnt from (
    select unnest(case when regexp_matches(t, '^[A-Za-z]') then list_transform(string_split(
             regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' '),
             lambda p: lower(p)) else [t] end) as token, n from {name}_raw
    union all
    select '</s>', sum({_lines_of(column)}) from {table} having sum({_lines_of(column)}) > 0
  ) group by token
)"""


_WORD = "regexp_matches(token, '^[A-Za-z]') and length(token) > 1"
_SPLITS = f"splits as (select token as word, cnt as freq, list_append(regexp_extract_all(token, '.'), '</w>') as symbols from wc where {_WORD})"
_BASE = f"""base as (
  select token from wc where not ({_WORD})
  union select unnest(list_concat(symbols, ['</w>', '</s>'])) from splits
)"""
_PAIRS = """occ as (
  select word, freq, symbols[i] as l, symbols[i + 1] as r from (select word, freq, symbols, unnest(range(1, len(symbols))) as i from splits)
)"""


def _merges(k: int) -> str:
    """k canonical merges, unrolled: symbols between marks, a merge is a replacement."""
    out = [f"code0 as (select freq, chr(1) || array_to_string(symbols, chr(2) || chr(1)) || chr(2) as code from splits)"]
    for i in range(k):
        out.append(f"""parts{i} as (
  select freq, string_split(code[2:-2], chr(2) || chr(1)) as s from code{i}
), best{i} as (
  select l, r, sum(freq)::bigint as c from (select freq, s[i] as l, s[i + 1] as r from (select freq, s, unnest(range(1, len(s))) as i from parts{i}))
  group by l, r order by c desc, l, r limit 1
), code{i + 1} as materialized (
  select freq, replace(code, chr(1) || l || chr(2) || chr(1) || r || chr(2), chr(1) || l || r || chr(2)) as code from code{i}, best{i}
)""")
    rows = " union all ".join(
        f'select {i}::integer as merge_no, l as "left", r as "right", l || r as token, c as cnt, false as phantom from best{i}' for i in range(k)
    )
    out.append(f"merges as ({rows})")
    return ", ".join(out)


_VOCABULARY = f"{_counts()}, {_SPLITS}, {_BASE}, {_merges(K)}, vocab as materialized (select token from base union select token from merges)"


def _rank(source: str) -> str:
    return f"select (row_number() over (order by length(token) desc, token) - 1)::integer as rank, token, length(token)::integer as len from {source}"


def _segments(words: str) -> str:
    """Greedy longest prefixes of each word and its end mark, step by step."""
    return f"""walk(word, rest, out) as (
  select word, word || '</w>', []::varchar[] from {words}
  union all
  select word, rest[length(p) + 1:], list_append(out, p) from (
    select w.word, w.rest, w.out,
           coalesce((select arg_max(v.token, length(v.token)) from vocab v where starts_with(w.rest, v.token)), w.rest[1:1]) as p
    from walk w where w.rest <> ''
  )
), segments as (select word, out as pieces from walk where rest = '')"""


def _with(parts: str, query: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{parts}\n{query}"


_WORDS_OF_COUNTS = "needed as (select token as word from wc where regexp_matches(token, '^[A-Za-z]'))"
_STATS = """stats as (
  select token, sum(n)::bigint as cnt from (
    select unnest(coalesce(pieces, [token])) as token, cnt as n from {source} left join segments on {source}.token = segments.word
    union all select token, 0 from vocab
  ) group by token
)"""

_SENTENCES = rf"""sent as (
  select 'c-' || conv_id || '-' || turn as id, {_bytes('text')} as v from conversations
  union all select 'b-' || item_id, {_bytes('text')} from benchmark
), toks as (
  select id, i, case when regexp_matches(t, '^[A-Za-z]') then lower(t) else t end as t, regexp_matches(t, '^[A-Za-z]') as is_word
  from (select id, ts, unnest(range(1, len(ts) + 1)) as i, ts[i] as t
        from (select id, regexp_extract_all(v, '[A-Za-z]+|[^A-Za-z{_SPACE}]') as ts from sent))
), needed as (select distinct t as word from toks where is_word)"""

_LINES = """lines as (
  select unnest(string_split(case when text like '%' || chr(10) then text[:-2] else text end, chr(10))) as line from documents where length(text) > 0
)"""
_LIMITS = "[" + ", ".join(repr(x) for x in poisson_limits(LAM)) + "]::double[]"
_VALUES = f"""ranked as ({_rank('base')}), cells as (
  select rank, token, j::integer as j,
         cast('0x' || substr(md5('{SEED}|' || token || '|' || cast(j as varchar)), 1, 13) as bigint)::double / {float(2**52)!r} as u
  from ranked, range({DIM}) t(j)
), vals as (
  select rank, token, j, round(cast(len(list_filter({_LIMITS}, lambda c: c <= u)) * (sin(rank + 1.0::double) + cos(j - 1.0::double)) * 0.1::double + 0.01::double as float)::double, 5) as value
  from cells
)"""
_BASE_ONLY = f"{_counts()}, {_SPLITS}, {_BASE}"


def _mark(part: str) -> str:
    return f"case when length(line) % 3 = 0 then '\"' when length(line) % 3 = 1 then '''' else '' end {part}"


_TRIM = "' ' || chr(9) || chr(13) || chr(10)"
_XOR = """s1 as (select seed, xor(seed, seed << 13) & 4294967295 as a from ids),
s2 as (select seed, xor(a, a >> 17) as b from s1), s3 as (select seed, xor(b, b << 5) & 4294967295 as state from s2)"""

SQL = {
    "word_counts": _with(_counts(), "select token, cnt from wc"),
    "line_count": f"select coalesce(sum({_lines_of('text')}), 0)::bigint as n_lines from documents",
    "merged_counts": _with(
        f"{_counts()}, {_counts('conversations', 'text', 'other')}",
        "select token, sum(cnt)::bigint as cnt from (select * from wc union all select * from other) group by token",
    ),
    "camel_split": _with(
        _counts("pages", "html"),
        r"select t as word, replace(regexp_replace(regexp_replace(t, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' ', '|') as pieces, "
        "n as cnt from wc_raw where regexp_matches(t, '^[A-Za-z]')",
    ),
    "unique_tokens": _with(_counts(), "select token from wc"),
    "unique_tokens_csv": _with(_counts(), "select token from wc"),
    "atomic_tokens": _with(_counts(), f"select token, cnt from wc where not ({_WORD})"),
    "bpe_candidates": _with(_counts(), f"select token, cnt from wc where {_WORD}"),
    "base_vocabulary": _with(_BASE_ONLY, "select token from base"),
    "initial_symbols": _with(f"{_counts()}, {_SPLITS}", "select word, freq, array_to_string(symbols, ' ') as symbols from splits"),
    "pair_stats": _with(f"{_counts()}, {_SPLITS}, {_PAIRS}", 'select l as "left", r as "right", sum(freq)::bigint as cnt from occ group by l, r'),
    "pair_index_sizes": _with(
        f"{_counts()}, {_SPLITS}, {_PAIRS}",
        'select l as "left", r as "right", count(distinct word)::bigint as n_words, count(*)::bigint as n_entries from occ group by l, r',
    ),
    "best_pair": _with(
        f"{_counts()}, {_SPLITS}, {_PAIRS}",
        'select l as "left", r as "right", sum(freq)::bigint as cnt from occ group by l, r order by cnt desc, l, r limit 1',
    ),
    "vocabulary_ranked": _with(_VOCABULARY, _rank("vocab")),
    "segment_words": _with(
        f"{_VOCABULARY}, needed as (select token as word from wc where {_WORD}), {_segments('needed')}",
        "select word, array_to_string(pieces, ' ') as pieces from segments", True,
    ),
    "segment_sentences": _with(
        f"{_VOCABULARY}, {_SENTENCES}, {_segments('needed')}, flat as (select id, i, coalesce(pieces, [t]) as ps from toks left join segments on is_word and t = word)",
        "select id, coalesce(sum(len(ps)), 0)::bigint as n_tokens, coalesce(string_agg(array_to_string(ps, ' '), ' ' order by i), '') as tokens "
        "from sent left join flat using (id) group by id", True,
    ),
    "token_stats": _with(f"{_VOCABULARY}, {_WORDS_OF_COUNTS}, {_segments('needed')}, {_STATS.format(source='wc')}", "select token, cnt from stats", True),
    "token_stats_csv": _with(f"{_VOCABULARY}, {_WORDS_OF_COUNTS}, {_segments('needed')}, {_STATS.format(source='wc')}", "select token, cnt from stats", True),
    "vocabulary_strays": _with(
        f"{_VOCABULARY}, {_counts('pages', 'html', 'other')}, needed as (select token as word from other where regexp_matches(token, '^[A-Za-z]')), "
        f"{_segments('needed')}, {_STATS.format(source='other')}",
        "select token, cnt from stats where token not in (select token from vocab)", True,
    ),
    "embedding_coefficients": _with(
        f"{_BASE_ONLY}, ranked as ({_rank('base')})",
        f"select rank, j::integer as j, round(sin(rank + 1.0::double) + cos(j - 1.0::double), 6) as coefficient from ranked, range({DIM}) t(j)",
    ),
    "token_vectors": _with(f"{_BASE_ONLY}, {_VALUES}", "select rank, token, j, value from vals"),
    "token_vectors_csv": _with(f"{_BASE_ONLY}, {_VALUES}", "select token, j, value from vals"),
    "vector_matrix_csv": _with(
        f"{_BASE_ONLY}, {_VALUES}",
        "select j, count(*)::bigint as n, round(sum(value), 3) as total from vals group by j",
    ),
    "stats_column_csv": _with(
        f"{_VOCABULARY}, {_WORDS_OF_COUNTS}, {_segments('needed')}, {_STATS.format(source='wc')}",
        "select cast(cnt as varchar) as value, count(*)::bigint as n from stats group by 1", True,
    ),
    "csv_fields": _with(
        f"{_LINES}, low as (select distinct trim(line, {_TRIM}) as l from lines where length(trim(line, {_TRIM})) > 0)",
        "select case when length(l) >= 2 and l[1] = '\"' and l[-1] = '\"' then replace(l[2:-2], '\"\"', '\"') "
        "when length(l) >= 2 and l[1] = chr(39) and l[-1] = chr(39) then l[2:-2] else l end as c0, "
        "length(l)::varchar || 'x' as c1, '' as c2, chr(39) || 'q' || chr(39) || length(l)::varchar || chr(39) || 'z' as c3, 5.0::double as number, 5::bigint as n_cells from low",
    ),
    "train_save_load": _with(_VOCABULARY, _rank("vocab")),
    "stream_word_counts": _with(_counts(), "select token, cnt from wc"),
    "xorshift_uniform": _with(
        f"ids as (select (doc_id + 1)::bigint as seed from documents), {_XOR}",
        "select seed, state::bigint as state, round(1.05::double + state::double / 4294967295.0::double * (10.0::double - 1.05::double), 9) as value from s3",
    ),
    "vector_inverse": "with n as (select vec_id, embedding as e, list_sum(list_transform(embedding, lambda x: x::double * x::double)) as q from embeddings) "
    "select vec_id, (i - 1)::integer as j, round((case when q <= 1e-9 then 0.0 else e[i]::double / q end)::float::double, 5) as value "
    "from (select vec_id, e, q, unnest(range(1, len(e) + 1)) as i from n)",
    "zero_vector_guard": "with s as (select vec_id, list_transform(embedding, lambda x: (x::double * case when vec_id % 4 = 0 then 0.0 else 2.0 end)::float) as e from embeddings), "
    "n as (select vec_id, e, list_sum(list_transform(e, lambda x: x::double * x::double)) as q from s) "
    "select vec_id, round(list_sum(list_transform(e, lambda x: (case when q <= 1e-9 then 0.0 else x::double / q end)::float::double)), 4) as total from n",
    "embedding_lookup": "select doc_id as vec_id, coalesce(len(embedding), 0)::bigint as width, round(embedding[1]::double, 6) as first "
    "from documents left join embeddings on doc_id = vec_id",
    "embedding_at_rank": "select vec_id as rank, (i - 1)::integer as j, round(embedding[i]::double, 6) as value "
    "from (select vec_id, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings where vec_id = 7)",
    "embedding_update": "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * case when vec_id % 3 = 0 then -1 else 1 end)), 4) as total from embeddings",
    "csv_escape": _with(
        _LINES,
        f"select line, case when length(trim(line, {_TRIM})) = 0 or regexp_matches(line, '[,\"\\r\\n]') then '\"' || replace(line, '\"', '\"\"') || '\"' else line end as field from lines",
    ),
    "header_predicate": _with(
        f"{_LINES}, made as (select case when length(line) % 5 = 0 then ' Token,' || line || ',COUNT' else line end as line from lines), "
        f"low as (select line, lower(trim(line, {_TRIM})) as l from made)",
        "select line, (contains(l, 'token') and (contains(l, 'count') or contains(l, 'repetitions'))) or (contains(l, 'word') and contains(l, 'count')) "
        "or contains(l, 'embedding') as is_header from low",
    ),
    "trim_quotes": _with(
        f"{_LINES}, made as (select ' ' || chr(9) || {_mark('')} || replace(line, '\"', '\"\"') || {_mark('')} || ' ' || chr(13) as line from lines), "
        f"low as (select line, trim(line, {_TRIM}) as l from made)",
        "select line, case when length(l) >= 2 and l[1] = '\"' and l[-1] = '\"' then replace(l[2:-2], '\"\"', '\"') "
        "when length(l) >= 2 and l[1] = '''' and l[-1] = '''' then l[2:-2] else l end as bare from low",
    ),
} | {
    name: _with(f"{_counts()}, {_SPLITS}, {_merges(K)}", "select * from merges")
    for name in ("bpe_merges_canonical", "bpe_merges_distributed", "bpe_merges_literal_first")
}
