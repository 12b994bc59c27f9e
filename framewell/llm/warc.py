"""WARC archives with a two-level capture index: compressed blocks of sorted keys under a sparse directory."""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewell.llm.files import located, read_range, write_file
from framewell.llm.tables import stored
from framewell.llm.url_filters import url_host
from framewell.session import scratch_path

#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 100
#: Lines of an index block.
BLOCK_LINES = 1000
#: Captures that a task looks up, and bytes of archives that a task reads back.
LOOKUPS, READ_BYTES = 200_000, 32 << 20
DATE = "1970-01-01T00:00:00Z"
_FOOTER = "<QQ"
_LOW = -(1 << 63)

Key = tuple[str, int]


def surt(url: Column) -> Column:
    """Sort key of a URL: host labels from the last to the first, ``)``, then the rest; without scheme. Control characters
    and blanks are escaped. Null and malformed URLs have the key ``)`` and the text itself."""
    text = F.coalesce(url, F.lit(""))
    host = F.array_join(F.reverse(F.split(url_host(url), "\\.")), ",")
    rest = F.regexp_replace(text, r"(?s)^.*?://[^/?#]*", "")
    return F.concat(host, F.lit(")"), F.regexp_replace(rest, r"[\x00-\x20\x7f]", "%20"))


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(1, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member of its own: a response with its payload, or a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[6:6] = [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    return _member("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Headers of the record and of its HTTP block, and the payload."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, key, url, payload, size, digest, refers_to``: of equal payloads of at least :data:`REVISIT_BYTES` bytes
    the smallest page_id is the response and the others refer to it. Rows that repeat it are responses too; rows without
    a page_id refer to it if there is one."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        surt(F.col(url)).alias("key"),
        F.col(url).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("size"),
        F.sha2(payload, 256).alias("digest"),
    )
    firsts = (
        rows.filter(F.col("size") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .drop("n")
    )
    # small payloads have no response to refer to; a key of their own spreads them, though many share a digest
    own = F.concat("digest", F.lit(" "), F.xxhash64("page_id", "url").cast("string"))
    keyed = rows.withColumn("_key", F.when(F.col("size") >= REVISIT_BYTES, F.col("digest")).otherwise(own))
    first = F.col("first")
    return keyed.join(firsts.withColumnRenamed("digest", "_key"), "_key", "left").select(
        *rows.columns, F.when(~F.col("page_id").eqNullSafe(first), first).alias("refers_to")
    )


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the rows of :func:`with_revisits`, an archive for each task, and return the captures
    ``(key, page_id, file, at, length)``. A record is written as it comes, so a task holds one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = located(folder)
        system.create_dir(path, recursive=True)
        context = TaskContext.get()
        name = f"pages-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        out, at = None, 0
        for b in batches:
            out = out or system.open_output_stream(f"{path}/{name}", compression=None)
            spans = []
            for row in zip(*(b.column(i).to_pylist() for i in range(1, 7)), strict=True):
                page_id, url, payload, size, digest, refers_to = row
                member = record(page_id, url, payload, size, digest, refers_to)
                out.write(member)
                spans.append((at, len(member)))
                at += len(member)
            columns = [
                b.column(0),
                b.column(1),
                pa.array([name] * b.num_rows),
                pa.array([s[0] for s in spans], pa.int64()),
                pa.array([s[1] for s in spans], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "page_id", "file", "at", "length"])
        if out:
            out.close()

    chosen = records.select("key", "page_id", "url", "payload", "size", "digest", "refers_to")
    return chosen.mapInArrow(run, "key string, page_id long, file string, at long, length long")


def _rank(key: str, page_id: int | None) -> Key:
    return key, _LOW if page_id is None else page_id


def write_index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the captures in order of key and page_id, a shard for each range of keys, and return the shards
    ``(shard, key, page_id)`` with the first capture of each.

    A shard is compressed blocks of lines, then the directory of the first captures and places of its blocks, then where
    the directory lies. A key that very many pages share is dealt by page_id too, so it spreads over several shards.
    """
    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[list] = []
        blocks: list[bytes] = []
        directory: list[list] = []
        at = 0

        def close() -> None:
            nonlocal at
            data = zlib.compress(json.dumps(lines).encode(), 1)
            directory.append([*_rank(lines[0][0], lines[0][1]), at, len(data)])
            blocks.append(data)
            at += len(data)
            lines.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines.append(list(row))
                if len(lines) >= block_lines:
                    close()
        if lines:
            close()
        if directory:
            top = zlib.compress(json.dumps(directory).encode(), 1)
            name = f"index-{TaskContext.get().partitionId():06d}"
            shard = write_file(folder, name, ".cdx", [*blocks, top, struct.pack(_FOOTER, at, len(top))])
            yield pa.RecordBatch.from_pydict({"shard": [shard], "key": [directory[0][0]], "page_id": [directory[0][1]]})

    return stored(ordered.mapInArrow(run, "shard string, key string, page_id long"), "index_shards")


class CaptureIndex:
    """Reader of the index: binary search in the shards, then in a shard's directory, then in one block."""

    def __init__(self, folder: str, shards: list[tuple[str, int, str]]) -> None:
        self.folder = folder
        self.firsts = [(k, p) for k, p, _ in shards]
        self.names = [name for _, _, name in shards]
        self.shard, self.block = None, None

    def _directory(self, shard: int) -> tuple[list[Key], list[list]]:
        if self.shard is None or self.shard[0] != shard:
            system, path = located(self.folder)
            with system.open_input_file(f"{path}/{self.names[shard]}") as f:
                f.seek(f.size() - struct.calcsize(_FOOTER))
                at, size = struct.unpack(_FOOTER, f.read(struct.calcsize(_FOOTER)))
                f.seek(at)
                entries = json.loads(zlib.decompress(f.read(size)))
            self.shard = shard, [(e[0], e[1]) for e in entries], entries
        return self.shard[1], self.shard[2]

    def _block(self, shard: int, entry: list) -> tuple[list[Key], list[list]]:
        place = shard, entry[2]
        if self.block is None or self.block[0] != place:
            lines = json.loads(zlib.decompress(read_range(self.folder, self.names[shard], entry[2], entry[3])))
            self.block = place, [_rank(line[0], line[1]) for line in lines], lines
        return self.block[1], self.block[2]

    def find(self, key: str, page_id: int | None) -> list[list]:
        """All captures of a key and page: ``[key, page_id, file, at, length]``."""
        want, found = _rank(key, page_id), []
        for shard in range(max(0, bisect_left(self.firsts, want) - 1), bisect_right(self.firsts, want)):
            firsts, entries = self._directory(shard)
            for k in range(max(0, bisect_left(firsts, want) - 1), bisect_right(firsts, want)):
                keys, lines = self._block(shard, entries[k])
                found += lines[bisect_left(keys, want) : bisect_right(keys, want)]
        return found


def look_up(folder: str, shards: DataFrame, queries: DataFrame, parts: int) -> DataFrame:
    """Captures of the distinct ``queries(key, page_id)`` by the index: ``(page_id, file, at, length)``.

    The list of shards, one row for each range of keys that :func:`write_index` dealt, goes to all tasks. Queries come in
    key order, so a task reads each of its blocks once. They are dealt to ``parts`` tasks, since their few bytes do not tell the
    work.
    """
    top = sorted((r.key, r.page_id, r.shard) for r in shards.collect())
    ordered = queries.distinct().repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(folder, top)
        for b in batches:
            asked = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
            found = [line for key, page_id in asked for line in index.find(key, page_id)]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
            columns = [pa.array([line[i] for line in found], t) for i, t in enumerate(types, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "file", "at", "length"])

    return ordered.mapInArrow(run, "page_id long, file string, at long, length long")


def read_records(folder: str, captures: DataFrame, parts: int) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` read by range from the archives, in file
    order by ``parts`` tasks. Size and digest of a response are those of the payload read, of a revisit those it states."""
    ordered = captures.repartitionByRange(parts, "file", "at").sortWithinPartitions("file", "at")

    def number(urn: str | None) -> int | None:
        digits = (urn or "")[len("<urn:page:") : -1]
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = located(folder)
        name, source = None, None
        for b in batches:
            rows: list[tuple] = []
            for file, at, length in zip(*(b.column(i).to_pylist() for i in range(1, 4)), strict=True):
                if file != name:
                    if source:
                        source.close()
                    name, source = file, system.open_input_file(f"{path}/{file}")
                source.seek(at)
                fields, http, payload = parse_record(source.read(length))
                kind = fields["WARC-Type"]
                size, digest = int(http["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                if kind == "response":
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                rows.append((number(fields["WARC-Record-ID"]), size, digest, kind, number(fields.get("WARC-Refers-To"))))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return ordered.mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    )


def archive_round_trip(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all ``pages`` to archives, index them, look every page up in the index and read its records back.

    Null html is an empty payload, null URLs an empty target; rows that repeat have a record each; no pages, no files.
    Other columns of ``pages`` are left out.
    """
    folder = scratch_path(pages.sparkSession, "warc")
    captures = stored(write_archives(with_revisits(pages, page_id, url, html), folder), "captures")
    shards = write_index(captures, folder)
    queries = pages.select(surt(F.col(url)).alias("key"), F.col(page_id).cast("long").alias("page_id"))
    lines, size = captures.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    least = pages.sparkSession.sparkContext.defaultParallelism
    found = stored(look_up(folder, shards, queries, max(least, lines // LOOKUPS)), "found")
    return read_records(folder, found, max(least, size // READ_BYTES))
