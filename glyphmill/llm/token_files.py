"""Documents as token ids in range-ANS files, in ascending order of their ids.

1. The documents are ordered by id (ties by a hash of the text, then by the row,
   nulls first), a distributed range sort in which copies of one row fill several
   partitions.  Each partition is tokenised and kept as one raw file.
2. The ids' frequencies, counted as the raw files are written, form the one table.
3. Each raw file is encoded to one token file; its first position follows from
   the counts of the partitions before it.
4. The token files are read back, a few blocks to a task: a task yields the
   documents that begin in its blocks.

Files are listed in manifests, which are tables: a repeated task leaves files
that nobody lists.  A task holds one block of tokens, whatever the file's size.

The tokenizer's own pre-tokenizer and model run on pieces that begin with a space
or a line end, where the pre-tokenizer splits in any case; results are kept for
the next time.  A text in which white space meets other white space in a way that
the pre-tokenizer looks ahead for, or a special token occurs, is encoded as one.

Defined results: a null text is empty and has the end id only; so has an empty
one.  A very long text spans blocks and is read by the task of its first one.
Repeated rows and repeated ids are encoded each, ties in the order of a hash of
the text.  A null id comes first and stays null.  An empty table gives no rows.
Ids must be integers.  Only the two named columns are read, so extra columns
don't matter, whatever their names.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import delete_path, materialise, quoted, scratch_path
from .rans import BLOCK_TOKENS, Reader, Table, Writer

END_ID = 0
#: Pieces that a worker keeps, at some 50 bytes each, and pre-tokens inside of new ones, at some 200.
MOST_PIECES = 1_200_000
MOST_INNER = 200_000
CHUNK_TOKENS = 1 << 20
#: Bytes of text that are cut into pieces at once.
SLICE_BYTES = 8 << 20
#: Blocks that one task of a reader begins with.
BLOCKS_A_TASK = 4

#: Marks in a prepared text: a line end, a text's beginning, its end id, a text that is encoded whole.
_LINE, _FIRST, _END, _WHOLE = "\x01", "\x02", "\x05", "\x06"
_OTHER_SPACE = r"\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}"
#: Where white space meets white space the pre-tokenizer looks ahead; texts with the marks above can't be prepared.
_UNSAFE = rf" (?:[ \n{_OTHER_SPACE}]|$)|\n\n(?:[ \n{_OTHER_SPACE}]|$)|\n[{_OTHER_SPACE}]|[{_OTHER_SPACE}][ \n{_OTHER_SPACE}]|[\x01\x02\x05\x06]"
#: Letters by every version of Unicode; other words go to the library's pre-tokenizer.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u0527\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
#: Printable ASCII marks: the byte letters of these are they themselves.
_MARKS = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_PLAIN = re.compile(rf"([{_MARKS}]*)([{_LETTERS}]*)([{_MARKS}]*)")


def _arrow(uri: str):
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def open_out(uri: str):
    system, path = _arrow(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_in(uri: str):
    system, path = _arrow(uri)
    return system.open_input_file(path)


class Known:
    """Pieces whose ids are known, as arrays; when there are too many, the half used last stays."""

    def __init__(self, most: int):
        self.most, self.now = most, 0
        self.names = pa.array([], pa.string())
        self.starts = self.sizes = np.empty(0, np.int64)
        self.used = np.empty(0, np.int32)
        self.ids = np.empty(0, np.uint32)

    def find(self, names: pa.Array) -> np.ndarray:
        """Places of names; -1 where there is none."""
        self.now += 1
        at = pc.fill_null(pc.index_in(names, value_set=self.names), -1).to_numpy().astype(np.int64)
        self.used[at[at >= 0]] = self.now
        return at

    def add(self, names: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.names = pa.concat_arrays([self.names, names])
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.used = np.concatenate([self.used, np.full(len(sizes), self.now, np.int32)])
        self.ids = np.concatenate([self.ids, ids])

    def cut(self, keep: np.ndarray) -> None:
        """Only the marked ones stay."""
        sizes = self.sizes[keep]
        ends = np.cumsum(sizes)
        self.ids = self.ids[np.repeat(self.starts[keep] - ends + sizes, sizes) + np.arange(int(sizes.sum()))]
        self.names, self.used = self.names.filter(pa.array(keep)), self.used[keep]
        self.starts, self.sizes = ends - sizes, sizes

    def turn(self) -> None:
        if len(self.sizes) > self.most:
            keep = np.zeros(len(self.sizes), bool)
            keep[np.argsort(-self.used, kind="stable")[: self.most // 2]] = True
            self.cut(keep)


def _byte_letters() -> dict[int, int]:
    """The letters by which a byte-level model writes bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return dict(zip(plain, plain)) | {b: 256 + k for k, b in enumerate(others)}


class PieceTokenizer:
    """Token ids of whole texts as little-endian 32-bit integers, by the library's own parts.

    The texts of a slice fall into pieces before their spaces and at their line
    ends; Arrow finds the distinct pieces.  A piece falls into the pre-tokens of
    the library's pre-tokenizer, and the library's model encodes each pre-token.
    """

    def __init__(self, path: str, most: int = MOST_PIECES, end_id: int = END_ID):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        parts = json.loads(self.tokenizer.to_str())
        splitter, model = parts["pre_tokenizer"] or {}, parts["model"]
        self.by_piece = (
            splitter.get("type") == "ByteLevel" and splitter.get("use_regex") and not splitter.get("add_prefix_space")
            and parts["normalizer"] is None and model["type"] == "BPE" and not model.get("dropout")
        )
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.unsafe = "|".join([_UNSAFE, *special]) if self.by_piece else "(?s:^)"
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.known = Known(most)
        #: ids of pre-tokens, written in byte letters
        self.inner: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self.model = self.tokenizer.model
        self.newline = self._ids(chr(self.letters[10])) if self.by_piece else b""
        self.space = chr(self.letters[32])
        self.end = struct.pack("=I", end_id)

    def _written(self, word: str) -> str:
        """A word in byte letters."""
        return word.encode().decode("latin-1").translate(self.letters)

    def _ids(self, token: str) -> bytes:
        """Ids of one pre-token in byte letters, kept for the next time."""
        ids = self.inner.get(token)
        if ids is None:
            if len(self.inner) >= MOST_INNER:
                self.inner.clear()
            self.inner[token] = ids = array("I", [t.id for t in self.model.tokenize(token)]).tobytes()
        return ids

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _body(self, body: str, space: str) -> bytes:
        """Ids of a piece without its mark; ``space`` stands before it, or nothing."""
        m = _PLAIN.fullmatch(body)
        # an apostrophe at the beginning may begin a contraction
        if m is None or (m[1] and not space and "'" in m[1]):
            made = self.tokenizer.pre_tokenizer.pre_tokenize_str(" " + body if space else body)
            return b"".join([self._ids(token) for token, _ in made])
        before, word, after = m.groups()
        out = b""
        if before:
            out = self._ids(space + before)
            space = ""
        if word:
            out += self._ids(space + (word if word.isascii() else self._written(word)))
        return out + self._ids(after) if after else out

    def _piece(self, piece: str, texts: pa.Array) -> bytes:
        """Ids of a piece of the prepared texts."""
        if piece.isalpha() and piece.isascii():
            return self._ids(self.space + piece)
        mark = piece[:1]
        if mark not in (_LINE, _FIRST, _END):
            return self._body(piece, self.space)
        if mark == _END:
            return self.end
        body = piece[1:]
        if body[:1] == _WHOLE:
            return self.whole(texts[int(body[1:])].as_py())
        ids = self._body(body, "") if body else b""
        return self.newline + ids if mark == _LINE else ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids), the end id behind each text; nulls are empty texts."""
        texts = pc.fill_null(texts, "")
        unsafe = pc.match_substring_regex(texts, self.unsafe)
        ready = pc.replace_substring(texts, "\n", " " + _LINE)
        if pc.any(unsafe).as_py():
            ready = pc.if_else(unsafe, pa.array([f"{_WHOLE}{k}" for k in range(len(texts))]), ready)
        cut = pc.split_pattern(pc.binary_join_element_wise(_FIRST, ready, " " + _END, ""), " ")
        coded = cut.flatten().dictionary_encode()
        known = self.known
        at = known.find(coded.dictionary)
        missing = at < 0
        old = len(known.sizes)
        if missing.any():
            new = coded.dictionary.filter(pa.array(missing))
            found = [self._piece(piece, texts) for piece in new.to_numpy(zero_copy_only=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
            known.add(new, sizes, np.frombuffer(b"".join(found), np.uint32))
            del found
            at[missing] = old + np.arange(len(sizes))
        place = at[coded.indices.to_numpy()]
        each = known.sizes[place]
        upto = np.cumsum(each)
        # each piece's place in the table less its place in the result, then a step for each id
        total = int(upto[-1]) if len(upto) else 0
        small = np.int32 if max(total, len(known.ids)) < 1 << 31 else np.int64
        take = np.repeat((known.starts[place] - upto + each).astype(small), each)
        take += np.arange(total, dtype=small)
        flat = known.ids[take]
        del take, place
        first = cut.offsets.to_numpy()
        before = np.concatenate([[0], upto])
        lengths = np.diff(before[first - first[0]]).astype("<u4")
        if missing.any():
            # what is long, or a whole text, isn't kept
            keep = np.ones(len(known.sizes), bool)
            keep[old:] = pc.and_(pc.less(pc.binary_length(new), 64), pc.invert(pc.match_substring(new, _WHOLE))).to_numpy(zero_copy_only=False)
            if not keep.all():
                known.cut(keep)
        known.turn()
        return lengths, flat

    def __call__(self, text: str) -> bytes:
        """Ids of one text, without the end id."""
        return self.encode(pa.array([text], pa.string()))[1][:-1].tobytes()


def slices(texts: pa.Array, most: int = 0) -> Iterator[tuple[int, pa.Array]]:
    """(place, part) for parts of an array of texts of about ``most`` bytes each, or one text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, done + (most or SLICE_BYTES), "right")))
        yield at, texts.slice(at, end - at)
        at = end


_TOKENIZERS: dict[tuple, PieceTokenizer] = {}


def _tokenizer(path: str, end_id: int) -> PieceTokenizer:
    """The worker's tokenizer with what it has kept: workers run many tasks."""
    if (path, end_id) not in _TOKENIZERS:
        _TOKENIZERS[path, end_id] = PieceTokenizer(path, end_id=end_id)
    return _TOKENIZERS[path, end_id]


def _write_raw(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Raw token files of an ordered frame; the manifest has part, path, tokens, wide and the counts of the ids."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        tokenizer = _tokenizer(tokenizer_path, end_id)
        wide = "<u4" if tokenizer.size > 65_536 else "<u2"
        press = zstandard.ZstdCompressor(1)
        path, out, total = f"{folder}/{uuid.uuid4().hex}.raw", None, 0
        counts = np.zeros(max(tokenizer.size, end_id + 1), np.int64)
        for batch in batches:
            for at, texts in slices(batch.column("text")):
                lengths, flat = tokenizer.encode(texts)
                keys = batch.column("id").slice(at, len(texts))
                known = keys.is_valid().to_numpy(zero_copy_only=False)
                if out is None:
                    out = open_out(path)
                for part in (pc.fill_null(keys, 0).to_numpy().astype("<i8"), known, lengths, flat.astype(wide)):
                    data = press.compress(part.tobytes())
                    out.write(struct.pack("<Q", len(data)) + data)
                counts += np.bincount(flat, minlength=len(counts))
                total += len(flat)
        if out is not None:
            out.close()
            row = {"part": [TaskContext.get().partitionId()], "path": [path], "tokens": [total], "wide": [wide],
                   "counts": [press.compress(counts.astype("<i8").tobytes())]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("path", pa.string()), ("tokens", pa.int64()), ("wide", pa.string()), ("counts", pa.binary())]))

    return materialise(docs.mapInArrow(write, "part int, path string, tokens long, wide string, counts binary"), "raw-tokens")


def _read_raw(path: str, wide: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    unpress = zstandard.ZstdDecompressor()
    with open_in(path) as stream:
        while head := stream.read(8):
            parts = []
            for kind in ("<i8", "?", "<u4", wide):
                if parts:
                    head = stream.read(8)
                (n,) = struct.unpack("<Q", head)
                data = stream.read(n)
                size = zstandard.frame_content_size(data)
                parts.append(np.frombuffer(unpress.decompress(data, max_output_size=max(size, 1)), kind))
            yield tuple(parts)


def _spread(manifest: DataFrame) -> DataFrame:
    return manifest.repartition(max(1, min(manifest.count(), 4096)))


def count_ids(raw: DataFrame) -> np.ndarray:
    """How often each id occurs in all raw files: counted as they were written, summed by Spark."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpress = zstandard.ZstdDecompressor()
        sums: np.ndarray | int = 0
        for batch in batches:
            for data in batch.counts:
                sums = sums + np.frombuffer(unpress.decompress(data), "<i8")
        seen = np.flatnonzero(sums)
        yield pd.DataFrame({"id": seen, "n": sums[seen] if len(seen) else seen})

    found = raw.select("counts").mapInPandas(unpack, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(int(found.id.max()) + 1 if len(found) else 1, np.int64)
    counts[found.id.to_numpy(np.int64)] = found.n.to_numpy(np.int64)
    return counts


def encode(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Writes token files and their table; returns the manifest (path, table, base, tokens, blocks)."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "token-files")
    # the row's number splits copies of one row; for rows read from files it is the same at every attempt
    narrow = docs.select(
        quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"), F.xxhash64(quoted(text_col)).alias("h"),
        F.monotonically_increasing_id().alias("m"),
    )
    ordered = narrow.repartitionByRange("id", "h", "m").sortWithinPartitions("id", "h", "m").select("id", "text")
    raw_folder = scratch_path(spark, "raw-token-files")
    raw = _write_raw(ordered, raw_folder, tokenizer_path, end_id)
    table = Table(count_ids(raw))
    table_path = f"{folder}/table"
    with open_out(table_path) as out:
        out.write(table.packed())
    shared = spark.sparkContext.broadcast(table.packed())
    # one row for each partition: few, and narrow
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = raw.drop("counts").withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        own = Table.unpacked(shared.value)
        for batch in batches:
            for path, wide, base, tokens in zip(batch.path, batch.wide, batch.base, batch.tokens):
                to = f"{folder}/{uuid.uuid4().hex}.rans"
                writer = Writer(open_out(to), own, int(base), block_tokens)
                for keys, known, lengths, flat in _read_raw(path, wide):
                    flat = flat.astype(np.uint32)
                    ends = np.cumsum(lengths, dtype=np.int64)
                    for key, there, n, end in zip(keys.tolist(), known.tolist(), lengths.tolist(), ends.tolist()):
                        writer.add(key if there else None, flat[end - n : end])
                writer.close()
                row = (to, table_path, int(base), int(tokens), len(writer.blocks))
                yield pd.DataFrame([row], columns=["path", "table", "base", "tokens", "blocks"])

    made = materialise(
        _spread(based).mapInPandas(write, "path string, table string, base long, tokens long, blocks int"), "token-manifest"
    )
    delete_path(spark, raw_folder)
    return made


def _tasks(manifest: DataFrame) -> DataFrame:
    """(path, table, first, last): the blocks of all files, a few to a row, over as many tasks."""
    step = F.lit(BLOCKS_A_TASK)
    firsts = manifest.withColumn("first", F.explode(F.sequence(F.lit(0), F.greatest(F.col("blocks") - 1, F.lit(0)), step)))
    rows = firsts.select("path", "table", "first", F.least(F.col("first") + step, "blocks").alias("last"))
    n = manifest.agg(F.sum(F.ceil(F.greatest(F.col("blocks"), F.lit(1)) / step))).first()[0] or 0
    return rows.repartition(max(1, min(int(n), 4096)))


def decode(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, ids) read from the token files, blocks in parallel."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for doc_id, start, ids in _documents(batches):
            yield pd.DataFrame({"doc_id": pd.array([doc_id], dtype="Int64"), "start": [start], "ids": [ids.tolist()]})

    return _tasks(manifest).mapInPandas(read, "doc_id long, start long, ids array<long>")


def digests(manifest: DataFrame) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) read from the token files, blocks in parallel."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
            return out.astype({"doc_id": "Int64"})

        rows: list[tuple] = []
        for doc_id, start, ids in _documents(batches):
            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            if len(rows) == 10_000:
                yield frame(rows)
                rows = []
        yield frame(rows)

    return _tasks(manifest).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(batches: Iterator[pd.DataFrame]):
    tables: dict[str, Table] = {}
    for batch in batches:
        for path, table, first, last in zip(batch.path, batch.table, batch["first"], batch["last"]):
            if table not in tables:
                with open_in(table) as stream:
                    tables[table] = Table.unpacked(stream.read())
            with open_in(path) as stream:
                yield from Reader(stream, stream.size(), tables[table]).documents(int(first), int(last))
