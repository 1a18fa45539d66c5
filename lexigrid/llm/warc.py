"""WARC archives, index first.

Writing gives an index: file, offset, length, URL and digest of every record. Reading takes any
selection of index rows, sorts them by place and reads neighbouring byte ranges at once.

Every record is a gzip member of its own. Of the records with equal payloads of at least
``min_revisit`` bytes, the one with the smallest page_id is a response that holds the payload;
the others are revisit records, whose HTTP head still states the full payload's length. Files
have names of their own for each attempt of a task, and only the index of the attempt that
succeeded names them, so a task that is run again (a lost executor, speculation) leaves at worst
files that nothing refers to.

Defined results: a null html is an empty payload; a null url is written as "about:blank" and stays
null in the index; rows that repeat a page_id are a record each, and each revisits, or is, the
response for its own payload (repeated whole rows are all responses if the first of them is); a
null page_id is larger than all others, and revisits none if there are only null ones; an empty table
gives an empty index. Other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ID = "urn:lexigrid:page:"
INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string())])
INDEX_SQL = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string"
READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
READ_SQL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
#: Archives are closed at about this size; index rows are read together by stretches of this size.
FILE_BYTES = 128 << 20
#: Salts of the join of pages with repeated payloads, so that no digest makes a hot task.
SALTS = 16


def _id(page) -> str:
    return f"<{ID}{'none' if page is None else page}>"


def record(page, url, payload: bytes, digest: str, refers_to=None, date: str = "2000-01-01T00:00:00Z") -> bytes:
    """One uncompressed WARC record."""
    kind = "response" if refers_to is None else "revisit"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(page)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url if url is not None else 'about:blank', safe=':/?#[]@!$&()*+,;=%~-._')}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if refers_to is None:
        block += payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_id(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC head, HTTP head and payload of an uncompressed record."""
    first, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda x: dict(line.split(": ", 1) for line in x.decode().split("\r\n")[1:] if line)
    warc = fields(first)
    http, _, payload = rest[: int(warc["Content-Length"])].partition(b"\r\n\r\n")
    return warc, fields(http), payload


def with_first(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """page_id, url, html, refers_to: the smallest page_id with the same payload, where that is another one.

    Rows meet their group by digest and salt; a group that is still a large part of all rows is
    split by adaptive skew handling, rows being the outer side."""
    full = F.coalesce("html", F.lit(""))
    salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
    rows = pages.select("page_id", "url", "html", F.sha2(full.cast("binary"), 256).alias("digest"), salt.alias("salt"), (F.octet_length(full) >= min_revisit).alias("long"))
    groups = rows.where("long").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    groups = groups.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    later = F.col("long") & (F.col("page_id").isNull() | (F.col("page_id") > F.col("first")))
    return rows.join(groups, ["digest", "salt"], "left").select("page_id", "url", "html", F.when(later, F.col("first")).alias("refers_to"))


def _writer(folder: str, level: int):
    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        for part in parts:
            rows = []
            for page, url, html, refers in zip(*(c for c in part.columns)):
                page, url, refers, payload = page.as_py(), url.as_py(), refers.as_py(), (html.as_py() or "").encode()
                if out is None:
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                digest = hashlib.sha256(payload).hexdigest()
                data = gzip.compress(record(page, url, payload, digest, refers), level, mtime=0)
                out.write(data)
                rows.append((page, url, name, at, len(data), digest, "response" if refers is None else "revisit"))
                at += len(data)
                if at >= FILE_BYTES:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), INDEX)] if rows else [pa.array([], f.type) for f in INDEX], schema=INDEX)
        if out is not None:
            out.close()

    return write


def write(pages: DataFrame, folder: str, *, min_revisit: int = 100, level: int = 4) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as WARC files into the URI ``folder`` and returns the
    index, which is stored there too."""
    rows = with_first(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), min_revisit)
    return common.table(rows.mapInArrow(_writer(f"{folder}/warc", level), INDEX_SQL), folder, "index")


def _reader(folder: str, gap: int, most: int, payloads: bool):
    def page_of(text: str):
        number = re.fullmatch(rf"<{ID}(-?\d+|none)>", text)[1]
        return None if number == "none" else int(number)

    def unpack(data: bytes, row: dict) -> tuple:
        warc, http, payload = parse(gzip.decompress(data))
        kind, digest = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha256:")
        if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(http["Content-Length"])) or digest != row["payload_digest"]:
            raise ValueError(f"record at {row['file']}:{row['offset']} is damaged")
        refers = page_of(warc["WARC-Refers-To"]) if kind == "revisit" else None
        return page_of(warc["WARC-Record-ID"]), int(http["Content-Length"]), digest, kind, refers, row["url"], payload if payloads and kind == "response" else None

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(f"{folder}/warc")
        name, handle = None, None

        def together(rows: list[dict]) -> pa.RecordBatch:
            nonlocal name, handle
            if rows[0]["file"] != name:
                if handle:
                    handle.close()
                name, handle = rows[0]["file"], fs.open_input_file(f"{root}/{rows[0]['file']}")
            base = rows[0]["offset"]
            handle.seek(base)
            data = handle.read(rows[-1]["offset"] + rows[-1]["length"] - base)
            found = [unpack(data[r["offset"] - base : r["offset"] - base + r["length"]], r) for r in rows]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), READ)], schema=READ)

        wait: list[dict] = []
        for part in parts:
            for row in part.to_pylist():
                if wait and (row["file"] != wait[0]["file"] or row["offset"] > wait[-1]["offset"] + wait[-1]["length"] + gap or row["offset"] + row["length"] > wait[0]["offset"] + most):
                    yield together(wait)
                    wait = []
                wait.append(row)
        if wait:
            yield together(wait)
        if handle:
            handle.close()

    return read


def read(selected: DataFrame, folder: str, *, gap: int = 256 << 10, most: int = 4 << 20, payloads: bool = True) -> DataFrame:
    """The records that the index rows ``selected`` name, as READ_SQL; payload is null for revisits.

    Rows are sorted by file and offset; ranges no more than ``gap`` bytes apart are fetched by one
    read of at most ``most`` bytes (or one record). Digests are verified."""
    stretch = F.floor(F.col("offset") / FILE_BYTES)
    rows = selected.select(*INDEX.names).repartition("file", stretch).sortWithinPartitions("file", "offset")
    return rows.mapInArrow(_reader(folder, gap, most, payloads), READ_SQL)
