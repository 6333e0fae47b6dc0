"""Legacy ARC archives and their conversion to WARC.

ARC files hold one line of fields before each document.  Version 1 has URL,
address, date, type and length; version 2 adds result code, checksum, location,
offset and file name.  The first record names the version.  The converter reads
line and declared length, never the content, to find the next record, and gives
each document a WARC record with an identifier, timestamp, type and digests.

Documents with equal payloads: that with the smallest id is the response, others
are revisits without payload.  Payloads under ``MIN_REVISIT`` bytes are always
responses.

Files are written under names of their own; only finished ones are listed in a
manifest, which is a table.  A task that is lost or repeated leaves files that
nobody lists.  A file ends at ``FILE_BYTES``, so that files can be converted and
read in parallel; memory holds one record.

Defined results: a null payload is empty.  A null id sorts last and is written
as absent; a string id with a line end or blanks around it is refused; rows that share the smallest id of a payload are all responses.  A
null URL becomes ``unknown:``; white space in one is escaped.  An empty table
gives no files and no rows.  Very long payloads are one record each.  Repeated
rows are a record each.  Extra columns, whatever their names, are not archived.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, quoted, scratch_path

MIN_REVISIT = 100
FILE_BYTES = 64_000_000
DATE = "20200101000000"
SPACE = uuid.UUID("6f1d7d0e-52f5-5a53-9f5c-0b6f2a7a1c11")
_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"),
}
_NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


# ---------------------------------------------------------------- files


def open_file(uri: str, write: bool = False):
    """A binary stream of a local, HDFS or object-store path."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    system, path = (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)
    if not write:
        return system.open_input_stream(path, compression=None)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def member(data: bytes) -> bytes:
    """A gzip member of its own, so that records can be read one by one."""
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Members:
    """Reads concatenated gzip members, or plain bytes, as lines and lengths."""

    def __init__(self, stream, chunk: int = 1 << 20):
        self.stream, self.chunk = stream, chunk
        self.z, self.left, self.buffer, self.at = None, b"", b"", 0
        head = self.stream.read(chunk)
        self.plain = not head.startswith(b"\x1f\x8b")
        self.left = head

    def _more(self) -> bool:
        """Adds bytes to the buffer; false at the end."""
        while True:
            raw, self.left = self.left, b""
            if not raw:
                raw = self.stream.read(self.chunk)
                if not raw:
                    if self.z is not None and not self.z.eof:
                        raise ValueError("the archive ends inside a gzip member")
                    return False
            if self.plain:
                out = raw
            else:
                if self.z is None or self.z.eof:
                    self.z = zlib.decompressobj(31)
                out = self.z.decompress(raw)
                self.left = self.z.unused_data
            if out:
                self.buffer, self.at = self.buffer[self.at :] + out, 0
                return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the archive."""
        while (end := self.buffer.find(b"\n", self.at)) < 0:
            if not self._more():
                if self.at < len(self.buffer):
                    raise ValueError("the archive ends inside a line")
                return None
        out, self.at = self.buffer[self.at : end], end + 1
        return out

    def take(self, n: int) -> bytes:
        parts, need = [], n
        while need > 0:
            if self.at >= len(self.buffer) and not self._more():
                raise ValueError(f"a record declares {n} bytes and has {n - need}")
            piece = self.buffer[self.at : self.at + need]
            parts.append(piece)
            self.at += len(piece)
            need -= len(piece)
        return b"".join(parts)


# ---------------------------------------------------------------- ARC


def arc_line(version: int, **fields) -> bytes:
    return (" ".join(str(fields[f]) for f in _FIELDS[version]) + "\n").encode()


def arc_head(version: int, name: str) -> bytes:
    body = f"{version} 0 glyphmill\n{_NAMES[version]}\n".encode()
    fields = {"url": f"filedesc://{name}", "ip": "0.0.0.0", "date": DATE, "type": "text/plain", "code": 200,
              "checksum": "-", "location": "-", "offset": 0, "filename": name, "length": len(body)}
    return arc_line(version, **fields) + body + b"\n"


def arc_record(version: int, url: str, content: bytes, offset: int, name: str) -> bytes:
    fields = {"url": url, "ip": "0.0.0.0", "date": DATE, "type": "text/html", "code": 200, "checksum": "-",
              "location": "-", "offset": offset, "filename": name, "length": len(content)}
    return arc_line(version, **fields) + content + b"\n"


def read_arc(source: Members) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(version, fields, content) of each record after the first, which names the version."""
    version = None
    while (line := source.line()) is not None:
        if not line.strip():
            continue
        parts = line.decode("utf-8").split(" ")
        if version is None:
            if not parts[0].startswith("filedesc:"):
                raise ValueError("an ARC file starts with its version record")
            body = source.take(int(parts[-1]))
            version = int(body.split(b" ", 1)[0])
            if version not in _FIELDS:
                raise ValueError(f"ARC version {version} is unknown")
            continue
        names = _FIELDS[version]
        if len(parts) != len(names):
            raise ValueError(f"an ARC line of version {version} has {len(names)} fields, not {len(parts)}")
        fields = dict(zip(names, parts))
        yield version, fields, source.take(int(fields["length"]))


def timestamp(date: str) -> str:
    """The WARC form of an ARC date of 4 to 14 digits; what is missing is its least value."""
    if not date.isdigit() or not 4 <= len(date) <= 14:
        raise ValueError(f"{date!r} is no ARC date")
    full = date + "00000101000000"[len(date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:]}Z"


# ---------------------------------------------------------------- WARC


def record_id(page_id: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}')}>"


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def to_warc(fields: dict[str, str], content: bytes, refers: str | None) -> bytes:
    """The WARC record of an ARC document; ``refers``: the id of the page with the same payload."""
    head, gap, payload = content.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        head, payload = b"", content
    page = headers(head).get("x-page-id")
    digest = hashlib.sha256(payload).hexdigest()
    named = {
        "WARC-Type": "response" if refers is None else "revisit",
        "WARC-Record-ID": record_id(page, digest),
        "WARC-Date": timestamp(fields["date"]),
        "WARC-Target-URI": fields["url"],
        "WARC-IP-Address": fields["ip"],
        "WARC-Payload-Digest": f"sha256:{digest}",
    }
    if not head:
        named["WARC-Type"] = "resource" if refers is None else "revisit"
    block = content
    if refers is not None:
        named["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        named["WARC-Refers-To"] = record_id(refers, digest)
        named["WARC-Refers-To-Page"] = refers
        block = head + gap
    named["WARC-Block-Digest"] = f"sha256:{hashlib.sha256(block).hexdigest()}"
    named["Content-Type"] = "application/http; msgtype=response" if head else fields["type"]
    return warc_record(named, block)


def warc_info(name: str) -> bytes:
    block = b"software: glyphmill\r\nformat: WARC File Format 1.1\r\n"
    named = {"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(SPACE, name)}>", "WARC-Date": timestamp(DATE),
             "WARC-Filename": name, "Content-Type": "application/warc-fields"}
    return warc_record(named, block)


def read_warc(source: Members) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of each record; digests of blocks are checked."""
    while (line := source.line()) is not None:
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a WARC record starts with its version")
        raw = []
        while (line := source.line()) is not None and line.strip():
            raw.append(line.rstrip(b"\r"))
        fields = headers(b"\r\n".join(raw))
        block = source.take(int(fields["content-length"]))
        wanted = fields.get("warc-block-digest")
        if wanted and wanted != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise ValueError(f"the block of {fields.get('warc-record-id')} is damaged")
        yield fields, block


# ---------------------------------------------------------------- Spark


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html") -> DataFrame:
    """``pages`` with ``refers``: the smallest id with the same payload, null for responses.

    Only keys are grouped, and only payloads that occur under several ids are
    joined: a table that Spark broadcasts if its measured size allows.
    """
    raw = F.coalesce(F.encode(quoted(payload_col), "UTF-8"), F.lit(b""))
    keyed = pages.select(
        quoted(id_col).alias("id"), F.octet_length(raw).alias("n"), F.sha2(raw, 256).alias("digest")
    ).filter(F.col("n") >= MIN_REVISIT)
    # null ids count as another, larger one
    same = keyed.groupBy("digest").agg(
        F.min("id").alias("__gm_first"),
        ((F.min("id") != F.max("id")) | ((F.count("id") > 0) & (F.count("id") < F.count(F.lit(1))))).alias("several"),
    )
    shared = materialise(same.filter("several").select(F.col("digest").alias("__gm_shared"), "__gm_first"), "shared-payloads")
    joined = pages.withColumn("__gm_digest", F.sha2(raw, 256)).join(shared, F.col("__gm_digest") == F.col("__gm_shared"), "left")
    own = quoted(id_col).eqNullSafe(F.col("__gm_first"))
    refers = F.when(F.col("__gm_first").isNotNull() & ~own, F.col("__gm_first")).alias("refers")
    kept = [c for c in pages.columns if c.lower() != "refers" or c == id_col]
    return joined.select(*[quoted(c) for c in kept], refers)


def _rolling(folder: str, ending: str, head: Callable[[int, str], bytes]) -> Callable:
    """A writer that starts a new file every ``FILE_BYTES`` and lists what it has finished."""

    class Writer:
        def __init__(self):
            self.done: list[tuple[str, list]] = []
            self.out = None
            self.index = 0

        def put(self, make: Callable[[int, int, str], bytes], note=None) -> None:
            if self.out is None:
                self.name = f"{uuid.uuid4().hex}{ending}"
                self.out = open_file(f"{folder}/{self.name}", write=True)
                first = member(head(self.index, self.name))
                self.out.write(first)
                self.size, self.notes = len(first), []
            data = member(make(self.index, self.size, self.name))
            self.out.write(data)
            self.size += len(data)
            if note is not None:
                self.notes.append(note)
            if self.size >= FILE_BYTES:
                self.close()

        def close(self) -> None:
            if self.out is not None:
                self.out.close()
                self.done.append((f"{folder}/{self.name}", self.notes))
                self.out = None
                self.index += 1

    return Writer


def write_arc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes ARC files, version 1 and 2 by turns; the manifest has path and revisits (ordinal, refers)."""
    named = pages.select(quoted(id_col).alias("__gm_page"), quoted(url_col).alias("__gm_url"), quoted(payload_col).alias("__gm_payload"))
    id_col, url_col, payload_col = named.columns
    rows = revisits(named, id_col, payload_col).select(
        quoted(id_col).cast("string").alias("id"),
        quoted(url_col).alias("url"),
        F.coalesce(F.encode(quoted(payload_col), "UTF-8"), F.lit(b"")).alias("payload"),
        F.col("refers").cast("string").alias("refers"),
    )
    writer = _rolling(folder, ".arc.gz", lambda k, name: arc_head(1 + (k + int(name[0], 16)) % 2, name))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, n = writer(), 0
        for batch in batches:
            for page, url, payload, refers in zip(batch.id, batch.url, batch.payload, batch.refers):
                if out.out is None:
                    n = 0
                if page is not None and len(page.splitlines()) > 1 or page is not None and page != page.strip():
                    raise ValueError(f"{page!r} can't be a field of a record")
                line = "" if page is None else f"X-Page-Id: {page}\r\n"
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n{line}\r\n".encode()
                target = "%20".join((url or "unknown:").split()) or "unknown:"
                out.put(
                    lambda k, size, name: arc_record(1 + (k + int(name[0], 16)) % 2, target, http + payload, size, name),
                    None if refers is None else f"{n} {refers}",
                )
                n += 1
        out.close()
        yield pd.DataFrame(out.done, columns=["path", "notes"])

    return materialise(rows.mapInPandas(write, "path string, notes array<string>"), "arc-manifest")


def _spread(manifest: DataFrame) -> DataFrame:
    files = manifest.count()
    return manifest.repartition(max(1, min(files, 4096)))


def convert(manifest: DataFrame, folder: str) -> DataFrame:
    """Converts the ARC files of a manifest to WARC files, file by file; returns their manifest."""
    writer = _rolling(folder, ".warc.gz", lambda _, name: warc_info(name))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = writer()
        for batch in batches:
            for path, notes in zip(batch.path, batch.notes):
                refers = dict(note.split(" ", 1) for note in notes)
                with open_file(path) as stream:
                    for n, (_, fields, content) in enumerate(read_arc(Members(stream))):
                        out.put(lambda *_: to_warc(fields, content, refers.get(str(n))))
        out.close()
        yield pd.DataFrame(out.done, columns=["path", "notes"])

    return materialise(_spread(manifest).mapInPandas(write, "path string, notes array<string>"), "warc-manifest")


def read_records(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """One row for each document of the WARC files: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    With ``payloads`` also the payload itself, null for revisits.
    """
    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string"
    names = [part.split()[0] for part in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch.path:
                rows: list[tuple] = []
                held = 0
                with open_file(path) as stream:
                    for fields, block in read_warc(Members(stream)):
                        kind = fields["warc-type"]
                        if kind == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        http = headers(head)
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        size = int(http["content-length"])
                        if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"the payload of {fields['warc-record-id']} is damaged")
                        row = (http.get("x-page-id"), size, digest, kind, fields.get("warc-refers-to-page"), fields["warc-target-uri"])
                        if payloads:
                            row += (payload if kind == "response" else None,)
                            held += len(payload)
                        rows.append(row)
                        if len(rows) >= 10_000 or held > 16_000_000:
                            yield pd.DataFrame(rows, columns=names + ["payload"] * payloads)
                            rows, held = [], 0
                yield pd.DataFrame(rows, columns=names + ["payload"] * payloads)

    return _spread(manifest).mapInPandas(read, schema + ", payload binary" * payloads)


def archive(pages: DataFrame, spark: SparkSession | None = None, folder: str | None = None, **columns) -> DataFrame:
    """Pages to ARC, ARC to WARC; returns the manifest of the WARC files."""
    session = spark or pages.sparkSession
    where = folder or scratch_path(session, "archives")
    return convert(write_arc(pages, f"{where}/arc", **columns), f"{where}/warc")


def typed(column: str, like: DataFrame, of: str) -> Column:
    """A text column cast back to the type of an id."""
    return quoted(column).cast(like.schema[of].dataType)
