"""WARC archives: write captures, read them back, and assemble transactions.

A capture is three records: request, response (or revisit) and metadata. Request and metadata name the
response in WARC-Concurrent-To. Of captures with equal payloads the one of the largest page id is the
response; the others are revisit records without a payload. Responses are written first, and tell their record
ids; a revisit names that of its response in WARC-Refers-To (of several equal responses, the least id).
Each record is a gzip member of its own. Reading parses every record, checks payload digests against the bytes,
joins the three kinds by record id into one nested row a capture, and finds what a revisit refers to by record id.

Defined cases: null html is an empty payload; rows that repeat page id and payload are captures of their own,
all responses if theirs is the largest id; a null page id counts as smaller than any other, and a group of
only null ids has only responses; a null url gives an empty target; empty tables give no archive and no row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, staged
from .storage import Shard, open_fs

#: Groups of equal payloads, of two rows at least, are broadcast up to this number; beyond, they are joined by shuffle.
BROADCAST_GROUPS = 500_000
SHARD_BYTES = 64 << 20
DATE = "2024-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, name: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    lines += [f"{k}: {v}" for k, v in headers] + [f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 6, mtime=0)


def capture(page_id, url, payload: bytes, digest: str, refers_to: str | None, name: str) -> list[bytes]:
    """Request, response or revisit, and metadata of one page."""
    uri = "".join((url or "").split())
    host, _, path = uri.partition("://")[2].partition("/")
    page = "" if page_id is None else str(page_id)
    target = [("WARC-Target-URI", uri), ("WARC-Page-ID", page)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    main = [*target, ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is None:
        body = record("response", f"urn:capture:{name}", main, http + payload)
    else:
        body = record("revisit", f"urn:capture:{name}", [*main, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                                                        ("WARC-Refers-To", refers_to)], http)
    beside = [*target, ("WARC-Concurrent-To", f"<urn:capture:{name}>")]
    ask = record("request", f"urn:request:{name}", [*beside, ("Content-Type", "application/http; msgtype=request")], f"GET /{path} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode())
    meta = record("metadata", f"urn:metadata:{name}", [*beside, ("Content-Type", "application/warc-fields")], f"payload-bytes: {len(payload)}\r\n".encode())
    return [ask, body, meta]


def leaders(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` as page_id, url, html, digest with ``leader``: the page id that a revisit refers to, else null."""
    base = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    base = base.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("large", F.octet_length("html") >= min_bytes)
    groups = base.filter("large").groupBy("digest").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("c")).filter("c > 1 and top is not null").select("digest", "top")
    groups = staged(groups, "groups")
    side = F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups
    joined = base.join(side, "digest", "left")
    return joined.select("page_id", "url", "html", "digest", F.when(F.col("large") & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("leader"), (F.col("page_id") == F.col("top")).alias("leads"))


def _write(rows: DataFrame, folder: str) -> DataFrame:
    """Captures of page_id, url, html, refers_to and leads; a row (path, n_records) a finished archive, and a row (digest, page_id,
    id) a response that leads."""
    kind = dict(rows.dtypes)["page_id"]

    def write(batches):
        shard, n, led = None, 0, []

        def told(path, records):
            out = [([path], [records], [None], [None], [None])] if path else []
            out += [([None], [None], [d], [p], [i]) for d, p, i in led]
            led.clear()
            columns = [sum((x[j] for x in out), []) for j in range(5)]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], page_type), pa.array(columns[4], pa.string())],
                                              names=["path", "n_records", "digest", "page_id", "id"])
        for batch in batches:
            page_type = batch.column(0).type
            for at in range(batch.num_rows):  # a row at a time: a batch of long payloads is not copied whole
                page_id, url, html, refers_to, leads = (c[at].as_py() for c in batch.columns)
                if shard is None:
                    shard, n = Shard(folder, ".warc.gz"), 0
                    shard.write(record("warcinfo", f"urn:info:{shard.uri.rpartition('/')[2]}", [("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                name, payload = f"{shard.uri.rpartition('/')[2].partition('.')[0]}-{n}", html.encode("utf-8", "surrogatepass")
                digest = payload_digest(payload)
                for part in capture(page_id, url, payload, digest, refers_to, name):
                    shard.write(part)
                if leads:
                    led.append((hashlib.sha1(payload).hexdigest(), page_id, f"<urn:capture:{name}>"))
                n += 3
                if shard.at >= SHARD_BYTES:
                    shard.close()
                    yield told(shard.uri, n)
                    shard = None
                elif len(led) >= 10_000:
                    yield told(None, None)
        if shard is not None:
            shard.close()
            yield told(shard.uri, n)
    return rows.mapInArrow(write, f"path string, n_records long, digest string, page_id {kind}, id string")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write all captures below ``folder``, responses before revisits; returns (path, n_records) of the archives, as
    stored tables."""
    every = leaders(pages, min_bytes)
    first = staged(_write(every.filter("leader is null").select("page_id", "url", "html", F.lit(None).cast("string").alias("refers_to"), F.coalesce("leads", F.lit(False)).alias("leads")), folder), "responses")
    ids = staged(first.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id")), "response-ids")
    side = F.broadcast(ids) if ids.count() <= BROADCAST_GROUPS else ids
    again = every.filter("leader is not null").join(side, "digest")
    second = staged(_write(again.select("page_id", "url", "html", F.col("id").alias("refers_to"), F.lit(False).alias("leads")), folder), "revisits")
    return first.unionByName(second).filter("path is not null").select("path", "n_records")


def members(stream):
    """(offset, bytes) of each gzip member of a binary stream."""
    left, at = b"", 0
    while True:
        if not left:
            left = stream.read(1 << 16)
            if not left:
                return
        start, inflate, out = at, zlib.decompressobj(31), []
        while not inflate.eof:
            chunk = left or stream.read(1 << 16)
            if not chunk:
                raise ValueError("archive ends within a record")
            out.append(inflate.decompress(chunk))
            left = inflate.unused_data
            at += len(chunk) - len(left)
        yield start, b"".join(out)


def parse(data: bytes) -> tuple[dict, bytes]:
    """Headers, names in lower case, and block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[:int(headers["content-length"])]


RECORDS = "path string, offset long, kind string, id string, concurrent_to string, page string, uri string, refers_to string, digest string, n_bytes long, fields string"


def read_archives(archives: DataFrame) -> DataFrame:
    """One row a record of the archives in column ``path``."""
    def read(frames):
        for frame in frames:
            for uri in frame["path"]:
                system, path = open_fs(uri)
                rows = []
                with system.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
                    for offset, data in members(stream):
                        h, block = parse(data)
                        kind, digest, n, fields = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:"), None, None
                        if kind == "response":
                            payload = block.partition(b"\r\n\r\n")[2]
                            if payload_digest(payload) != digest:
                                raise ValueError(f"{uri} at {offset}: payload digest differs")
                            n = len(payload)
                        elif kind in ("metadata", "request"):
                            fields = block.decode("utf-8", "replace")
                        rows.append((uri, offset, kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-page-id"), h.get("warc-target-uri"), h.get("warc-refers-to"), digest or None, n, fields))
                        if len(rows) >= 5000:
                            yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
                            rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in RECORDS.split(", ")])
    paths = archives.select("path")
    return paths.repartitionByRange(max(1, archives.count()), "path").mapInPandas(read, RECORDS)  # an archive, of bounded size, a task


def assemble(records: DataFrame) -> DataFrame:
    """One nested row a capture: structs request, response (or revisit) and metadata, and the page that a revisit
    refers to, found by the id of the record that it names."""
    main = records.filter("kind in ('response', 'revisit')").select("id", "refers_to", F.struct("path", "offset", "kind", "id", "page", "uri", "refers_to", "digest", "n_bytes").alias("response"))
    request = records.filter("kind = 'request'").select(F.col("concurrent_to").alias("id"), F.struct("path", "offset", "id", "fields").alias("request"))
    metadata = records.filter("kind = 'metadata'").select(F.col("concurrent_to").alias("id"), F.struct("path", "offset", "id", "fields").alias("metadata"))
    named = records.filter("refers_to is not null").select("refers_to").distinct()
    named = staged(named.join(records.filter("kind = 'response'").select("id", "page"), F.col("refers_to") == F.col("id")).select("refers_to", F.col("page").alias("refers_to_page")), "referred")
    side = F.broadcast(named) if named.count() <= BROADCAST_GROUPS else named
    whole = main.join(request, "id", "left").join(metadata, "id", "left").join(side, "refers_to", "left")
    return whole.select("request", "response", "metadata", "refers_to_page")


def captures(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` to archives, read them back and assemble."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return assemble(staged(read_archives(write_archives(pages, folder, min_bytes)), "records"))


def digest(nested: DataFrame) -> DataFrame:
    """The flat columns of a capture."""
    meta = F.regexp_extract("metadata.fields", r"payload-bytes: ([0-9]+)", 1).cast("long")
    page = F.when(F.col("response.page") != "", F.col("response.page")).cast("long")
    return nested.select(page.alias("page_id"), F.coalesce("response.n_bytes", meta).alias("payload_bytes"), F.col("response.digest").alias("payload_digest"),
                         F.col("response.kind").alias("record_type"), F.col("refers_to_page").cast("long").alias("refers_to"))
