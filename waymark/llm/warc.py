"""WARC archives with a two-level capture index.

Records are gzip members of archive files. The index sorts captures by reversed-host URL key (and page id, then place)
into compressed blocks; a sparse directory keeps the first key of each block. A lookup searches the directory by
bisection, reads one block by its byte range, and then records by theirs. A key may have many captures, over many
blocks and shards.

Archives and index shards are files in a folder that all executors share. Files are named anew by each task
attempt; a file counts only once the rows that name it are in the staged tables, so retries do no harm.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, id_key, join_heavy, key_id, new_folder, quoted, stage, text_bytes

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID_BASE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of RFC 4122
#: Captures in an index block.
BLOCK = 500


def url_key(url: str) -> str:
    """Reversed-host key: http://b.example.com:80/p?q to com,example,b:80)/p?q, hosts lower-cased, fragment dropped."""
    rest = url.partition("://")[2] or url
    rest = rest.partition("#")[0]
    host, path = re.match(r"([^/?]*)(.*)", rest, re.S).groups()
    name, colon, port = host.lower().partition(":")
    key = ",".join(reversed(name.split("."))) + colon + port + ")" + (path or "/")
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", key)


def _key(page_id: int, url: str) -> str:
    return f"{url_key(url)} {page_id - NULL_ID:020d}"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_ID_BASE, f'page:{page_id}')}>"


def _member(kind: str, page_id: int, url: str, digest: str, date: str, body: bytes, extra: list[str], level: int) -> bytes:
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", *extra, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", compresslevel=level, mtime=0)


def response_record(page_id: int, url: str, payload: bytes, digest: str, date: str, level: int = 3) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _member("response", page_id, url, digest, date, head + payload, [], level)


def revisit_record(page_id: int, url: str, digest: str, date: str, refers_to: int, level: int = 3) -> bytes:
    return _member("revisit", page_id, url, digest, date, b"HTTP/1.1 200 OK\r\n\r\n", [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to)}"], level)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-cased names) and payload of one gzip member."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    body = rest[: int(fields["content-length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


@dataclass
class Archive:
    """The index of an archive: where its shards lie, in order, and the first and last key of each."""

    folder: str
    shards: list[str]
    firsts: list[str]
    lasts: list[str]


def _made_responses(pages: DataFrame, id_col: str, url_col: str, payload_col: str, date: str) -> DataFrame:
    """(id, url, sha1, size, member): each page's record as if it were a response."""
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("sha1", pa.binary()), ("size", pa.int64()), ("member", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, urls, payloads = (b.column(i).to_pylist() for i in range(3))
            digests = [hashlib.sha1(p).digest() for p in payloads]
            members = [response_record(i, u, p, base64.b32encode(d).decode(), date) for i, u, p, d in zip(ids, urls, payloads, digests)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(digests, type=pa.binary()), pa.array([len(p) for p in payloads], type=pa.int64()), pa.array(members, type=pa.binary())], schema=schema)

    rows = pages.select(id_key(F.col(quoted(id_col))).alias("id"), F.coalesce(F.col(quoted(url_col)), F.lit("")).alias("url"), text_bytes(F.col(quoted(payload_col))).alias("payload"))
    return rows.mapInArrow(run, "id long, url string, sha1 binary, size long, member binary")


def _archived(records: DataFrame, folder: str, date: str) -> DataFrame:
    """Writes an archive file per task and returns the captures: key, entry."""
    schema = pa.schema([("key", pa.string()), ("entry", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(folder)
        name, out, at = f"part-{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            keys, entries = [], []
            for page, url, sha1, size, member, first in zip(*(b.column(i).to_pylist() for i in range(6))):
                kind = "response" if first is None else "revisit"
                if first is not None:
                    member = revisit_record(page, url, base64.b32encode(sha1).decode(), date, first)
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member)
                keys.append(_key(page, url))
                entries.append(json.dumps({"type": kind, "file": name, "offset": at, "length": len(member), "payload": size, "refers_to": first}, separators=(",", ":")))
                at += len(member)
            yield pa.record_batch([pa.array(keys, type=pa.string()), pa.array(entries, type=pa.string())], schema=schema)
        if out is not None:
            out.close()

    return records.select("id", "url", "sha1", "size", "member", "first").mapInArrow(run, "key string, entry string")


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> Archive:
    """Writes a record per page and the index. Of equal payloads of at least `min_revisit_bytes`, the smallest id is the response.

    A null payload is empty, a null url is '', a null id comes before all others; rows that repeat an id and a url are
    captures of one key, each with its own record; those that repeat an id and a payload are records of the same
    kind; an empty table gives an archive without files.
    """
    folder = new_folder(pages.sparkSession, "warc")
    payload = text_bytes(F.col(quoted(payload_col)))
    marks = pages.select(id_key(F.col(quoted(id_col))).alias("id"), F.unhex(F.sha1(payload)).alias("sha1"), F.octet_length(payload).alias("size")).where(F.col("size") >= min_revisit_bytes)
    firsts = marks.groupBy("sha1").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")).where("last > first")
    firsts = stage(firsts.select("sha1", "first", "n"), "firsts")
    again = join_heavy(marks, firsts, ["sha1"], "n").where("id > first").select("id", "sha1", "first").distinct()
    made = _made_responses(pages, id_col, url_col, payload_col, date)
    joined = made.join(again, ["id", "sha1"], "left")
    captures = stage(_archived(joined, folder, date), "captures")
    return _indexed(captures, folder)


def _indexed(captures: DataFrame, folder: str) -> Archive:
    """Sorts captures into shards of compressed blocks; each shard ends with its directory."""
    schema = pa.schema([("first", pa.string()), ("last", pa.string()), ("entry", pa.string()), ("shard", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(folder)
        name, out, at, lines, directory = f"shard-{uuid.uuid4().hex}.idx", None, 0, [], []
        first = last = None

        def flush():
            nonlocal at, lines
            block = zlib.compress("".join(f"{k} {e}\n" for k, e in lines).encode(), 6)
            out.write(block)
            directory.append((lines[0][0], at, len(block)))
            at += len(block)
            lines = []

        for b in batches:
            for line in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if out is None:
                    out, first = fs.open_output_stream(f"{base}/{name}", compression=None), line
                lines.append(line)
                last = line[0]
                if len(lines) == BLOCK:
                    flush()
        if out is not None:
            if lines:
                flush()
            tail = zlib.compress(json.dumps(directory).encode())
            out.write(tail + len(tail).to_bytes(8, "little"))
            out.close()
            yield pa.record_batch([pa.array([x]) for x in (first[0], last, first[1], name)], schema=schema)

    # by place too, so that the captures of one key can be dealt to many shards
    made = captures.repartitionByRange("key", "entry").sortWithinPartitions("key", "entry").mapInArrow(run, "first string, last string, entry string, shard string")
    found = sorted((r["first"], r["entry"], r["last"], r["shard"]) for r in stage(made, "shards").collect())  # a row per shard
    return Archive(folder, [f[3] for f in found], [f[0] for f in found], [f[2] for f in found])


def _range(fs: FileSystem, path: str, handles: dict, offset: int, length: int) -> bytes:
    if path not in handles:
        if len(handles) > 64:
            for h in handles.values():
                h.close()
            handles.clear()
        handles[path] = fs.open_input_file(path)
    return handles[path].read_at(length, offset)


def _directory(fs: FileSystem, path: str, handles: dict) -> list:
    size = fs.get_file_info(path).size
    tail = int.from_bytes(_range(fs, path, handles, size - 8, 8), "little")
    return json.loads(zlib.decompress(_range(fs, path, handles, size - 8 - tail, tail)))


#: A task yields what it has read when it holds this many bytes of payload.
_READ = 16 << 20


def lookup(archive: Archive, wanted: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Reads all captures of (id, url) keys back: id, url, record_type, payload_bytes, payload_digest, refers_to, payload.

    Each key is looked up once, however often it is asked for, and yields a row for each of its captures. Keys that are
    not in the archive yield nothing; a revisit has no payload of its own. Null urls and ids as in write_archive().
    """
    spark = wanted.sparkSession
    shared = spark.sparkContext.broadcast(archive)

    @F.pandas_udf("array<int>")
    def shards_of(keys: pd.Series) -> pd.Series:
        """The shards that may hold each key: those whose first and last keys enclose it."""
        a = shared.value
        return pd.Series([list(range(bisect.bisect_left(a.lasts, k), bisect.bisect_right(a.firsts, k))) for k in keys], dtype=object)

    @F.pandas_udf("string")
    def keys_of(ids: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([_key(i, u) for i, u in zip(ids, urls)], dtype=object)

    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def entries(fs: FileSystem, path: str, files: dict, directory: list, keys: list[str], held: dict, key: str) -> Iterator[dict]:
        """A key's captures in one shard; its entries may run over several blocks. `held` keeps the last block read."""
        block = max(0, bisect.bisect_left(keys, key) - 1)
        while block < len(directory) and keys[block] <= key:
            if held.get("at") != (path, block):
                text = zlib.decompress(_range(fs, path, files, *directory[block][1:])).decode()
                held["at"], held["lines"] = (path, block), {}
                for line in text.split("\n")[:-1]:
                    k, _, entry = line.rpartition(" {")
                    held["lines"].setdefault(k, []).append("{" + entry)
            yield from map(json.loads, held["lines"].get(key, ()))
            block += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = FileSystem.from_uri(shared.value.folder)
        files, records, held = {}, {}, {}
        now, directory, keys = None, [], []
        out: list[list] = [[] for _ in schema]
        size = 0
        for b in batches:
            for page, url, key, shard in zip(*(b.column(i).to_pylist() for i in range(4))):
                path = f"{base}/{shared.value.shards[shard]}"
                if shard != now:
                    now, directory = shard, _directory(fs, path, files)
                    keys = [d[0] for d in directory]
                for e in entries(fs, path, files, directory, keys, held, key):
                    fields, payload = parse_record(_range(fs, f"{base}/{e['file']}", records, e["offset"], e["length"]))
                    digest, revisit = fields["warc-payload-digest"].removeprefix("sha1:"), e["type"] == "revisit"
                    if fields["warc-type"] != e["type"] or not revisit and sha1_base32(payload) != digest:
                        raise ValueError(f"record of {key} is damaged")
                    row = (page, url, fields["warc-type"], e["payload"] if revisit else len(payload), digest, e["refers_to"], None if revisit else payload)
                    for column, value in zip(out, row):
                        column.append(value)
                    size += len(payload)
                    if size >= _READ or len(out[0]) >= 10_000:
                        yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(out, schema)], schema=schema)
                        out, size = [[] for _ in schema], 0
        yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(out, schema)], schema=schema)

    rows = wanted.select(id_key(F.col(quoted(id_col))).alias("id"), F.coalesce(F.col(quoted(url_col)), F.lit("")).alias("url")).distinct()
    rows = rows.withColumn("key", keys_of("id", "url")).select("id", "url", "key", F.explode(shards_of("key")).alias("shard"))
    # by key, not by shard: a task reads a stretch of the index, however large shards are
    rows = rows.repartitionByRange("shard", "key").sortWithinPartitions("shard", "key")
    made = rows.mapInArrow(run, "id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
    return made.select(key_id("id").alias(id_col), F.col("url").alias(url_col), "record_type", "payload_bytes", "payload_digest", key_id("refers_to").alias("refers_to"), "payload")
