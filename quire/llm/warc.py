"""WARC archives with a two-level capture index.

Captures are dealt by ranges of their key (the host's labels in reverse, then the rest of the URL), so a task
writes one archive in key order, one gzip member a record, and beside it an index: lines of captures in
compressed blocks, and a directory of each block's first key. A manifest, written as a table, has one row for
each archive. To look a URL up: bisect the manifest, then the directory, then one block, and read the record's
range.

Of records with one payload of `REVISIT_BYTES` or more, the one with the largest page_id is a response, the
others are revisits that refer to it.

Files have names of their task's attempt alone, and the manifest lists those that count, so tasks can be run again.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import filesystem, in_small_batches, passing, rows, salted_join, scratch, shared_folder, stored

REVISIT_BYTES = 1000
#: Captures a block of the index.
BLOCK = 512
MAGIC = b"QCDX\x01\0\0\0"
#: What records say of the time of capture, which the tables lack: fixed, so that reruns write the same bytes.
DATE = "2000-01-01T00:00:00Z"
_PAGE = "urn:page:"


def url_key(url: Column) -> Column:
    """org,example)/path of http://example.org/path; the host in lower case, the scheme and fragment left out."""
    address = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?", "")
    address = F.regexp_replace(address, "#.*$", "")
    host = F.lower(F.regexp_extract(address, "^[^/?]*", 0))
    rest = F.regexp_replace(address, "^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def key_of(url: str | None) -> str:
    """As url_key."""
    address = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?", "", url or "")
    address = re.sub("#.*$", "", address)
    host = re.match("[^/?]*", address)[0]
    return ",".join(reversed(host.lower().split("."))) + ")" + address[len(host) :]


def planned(pages: DataFrame) -> DataFrame:
    """key, page_id, digest, mark, url, payload, refers_to: a row for each page (mark 1), and in front of it, for a
    revisit, one without payload (mark 0) that has the response's page_id.

    Only digests are joined. Payloads meet their marks by being dealt and sorted alike, so they are shuffled once.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    own = in_small_batches(pages).select(
        url_key(F.col("url")).alias("key"),
        F.col("page_id").cast("long"),
        F.sha1(payload).alias("digest"),
        F.lit(1).alias("mark"),
        "url",
        payload.alias("payload"),
        F.lit(None).cast("long").alias("refers_to"),
    )
    long = own.filter(F.octet_length("payload") >= REVISIT_BYTES).select("key", "page_id", "digest")
    # Of rows that share the largest id, the one with the least key is the one that is referred to.
    groups = long.groupBy("digest").agg(
        F.min(F.when(F.col("page_id").isNotNull(), F.struct(-F.col("page_id"), "key"))).alias("first"),
        F.max("page_id").alias("refers_to"),
        F.count("*").alias("n"),
    )
    groups = groups.filter("n > 1 AND refers_to IS NOT NULL").select("digest", "refers_to", _name("refers_to", "first.key").alias("name"))
    # A popular payload has many revisits; its row is there for each cell of them.
    revisits = salted_join(long.distinct(), groups, ["digest"], "key").filter("NOT page_id <=> refers_to")
    marks = stored(revisits, "revisits").select(
        "key", "page_id", "digest", F.lit(0).alias("mark"), F.col("name").alias("url"),
        F.lit(None).cast("binary").alias("payload"), "refers_to",
    )
    return own.union(marks)


def _name(page_id: str, key: str) -> Column:
    """page_id and a hash of the key: what a record's id is made of."""
    return F.concat_ws(":", F.coalesce(F.col(page_id).cast("string"), F.lit("none")), F.substring(F.sha1(F.col(key)), 1, 16))


def name_of(page_id: int | None, key: str) -> str:
    """As _name."""
    return f"{'none' if page_id is None else page_id}:{hashlib.sha1(key.encode()).hexdigest()[:16]}"


#: The head of the HTTP message of which a payload is the body; its length is put in.
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def record(name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str = DATE) -> bytes:
    """A WARC/1.1 record as one gzip member. name and refers_to are what ids are made of."""
    kind, block = ("response", HTTP.format(len(payload)).encode() + payload) if refers_to is None else ("revisit", b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_PAGE}{name}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", " ", url))
    if refers_to is None:
        lines.append("Content-Type: application/http; msgtype=response")
    else:
        lines.append(f"WARC-Refers-To: <{_PAGE}{refers_to}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])]


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP message."""
    return block.partition(b"\r\n\r\n")[2]


class IndexWriter:
    """Captures in key order, in compressed blocks, then the directory of first keys, its length and the magic."""

    def __init__(self, file):
        self.file, self.offset, self.directory, self.held = file, 0, [], []
        self.n, self.first, self.last = 0, None, None

    def add(self, key: str, page_id: int | None, offset: int, length: int) -> None:
        self.first, self.last = key if self.n == 0 else self.first, key
        self.held.append((key, page_id, offset, length))
        self.n += 1
        if len(self.held) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        data = zlib.compress(json.dumps(self.held).encode(), 6)
        self.directory.append((self.held[0][0], self.offset, len(data)))
        self.file.write(data)
        self.offset += len(data)
        self.held = []

    def close(self) -> None:
        if self.held:
            self._flush()
        data = zlib.compress(json.dumps(self.directory).encode(), 6)
        self.file.write(data + struct.pack("<Q", len(data)) + MAGIC)


class Index:
    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2) or file.tell()
        file.seek(end - 16)
        tail = file.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a whole index")
        (length,) = struct.unpack("<Q", tail[:8])
        file.seek(end - 16 - length)
        self.directory = json.loads(zlib.decompress(file.read(length)))

    def block(self, i: int) -> list:
        _, offset, length = self.directory[i]
        self.file.seek(offset)
        return json.loads(zlib.decompress(self.file.read(length)))

    def find(self, key: str) -> list:
        """All captures of a key: they may begin in the block before the first one whose first key is the key."""
        found = []
        for i in range(max(0, bisect_left(self.directory, key, key=lambda d: d[0]) - 1), bisect_right(self.directory, key, key=lambda d: d[0])):
            captures = self.block(i)
            at = bisect_left(captures, key, key=lambda c: c[0])
            found += captures[at : bisect_right(captures, key, key=lambda c: c[0])]
        return found


_MANIFEST = "file string, part int, first_key string, last_key string, records long"


def _batch(schema: str, kinds: list, out: list) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    columns = zip(*out, strict=True) if out else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def _write(folder: str, date: str):
    def write(batches):
        fs, root = filesystem(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.warc.gz"
        stream, index, offset, revisit, last, again = None, None, 0, (None, None, None), None, 0
        for batch in rows(batches):
            for key, page_id, digest, mark, url, payload, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not mark:
                    revisit = (key, page_id, digest), first, url
                    continue
                if stream is None:
                    fs.create_dir(root, recursive=True)
                    stream = fs.open_output_stream(f"{root}/{name}", compression=None)
                    of_index = fs.open_output_stream(f"{root}/{name}.cdx", compression=None)
                    index = IndexWriter(of_index)
                # The first record of a page and URL is named after them; others after their place, too.
                again = again + 1 if last == (key, page_id) else 0
                last = key, page_id
                own = name_of(page_id, key) + (f":{part}.{index.n}" if again or page_id is None else "")
                data = record(own, url, payload, digest, revisit[2] if revisit[0] == (key, page_id, digest) else None, date)
                stream.write(data)
                index.add(key, page_id, offset, len(data))
                offset += len(data)
        if stream is not None:
            index.close()
            of_index.close()
            stream.close()
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64()]
            yield _batch(_MANIFEST, kinds, [(name, part, index.first, index.last, index.n)])

    return write


def write_archives(pages: DataFrame, folder: str, date: str = DATE) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, html); returns the manifest.

    `folder` is one that Spark and Arrow both reach. Rows that repeat a page_id and URL are in one task.
    """
    folder = shared_folder(pages.sparkSession, folder)
    filesystem(folder)  # fails here rather than in a task
    # A host or URL with many captures is split between ranges by page_id, captures without one by their digest.
    with passing(pages.sparkSession):
        dealt = planned(pages).withColumn("apart", F.when(F.col("page_id").isNull(), F.col("digest")))
        dealt = dealt.repartitionByRange("key", "page_id", "apart").drop("apart")
        dealt = dealt.sortWithinPartitions("key", "page_id", "digest", "mark")
        dealt.mapInArrow(_write(folder, date), _MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


_RECORD = "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long"
_PLACED = f"{_RECORD}, at long"


def _page(text: str | None) -> int | None:
    found = re.match(rf"<{_PAGE}(-?\d+):", text or "")
    return int(found[1]) if found else None


def _row(member: bytes) -> tuple:
    headers, block = parsed(member)
    kind, stated = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    ids = _page(headers["WARC-Record-ID"]), _page(headers.get("WARC-Refers-To"))
    if kind == "revisit":
        return ids[0], kind, ids[1], stated, None
    payload = payload_of(block)
    if (digest := hashlib.sha1(payload).hexdigest()) != stated:
        raise ValueError(f"record {ids[0]}: the payload's digest is {digest}, not {stated}")
    return ids[0], kind, None, digest, len(payload)


_RECORD_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def _read(folder: str):
    def read(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{root}/{name}.cdx") as of_index, fs.open_input_file(f"{root}/{name}") as archive:
                    index = Index(of_index)
                    for i in range(len(index.directory)):
                        out = []
                        for _, _, offset, length in index.block(i):
                            archive.seek(offset)
                            out.append((*_row(archive.read(length)), offset))
                        yield _batch(_PLACED, [*_RECORD_KINDS, pa.int64()], out)

    return read


def resolved(records: DataFrame) -> DataFrame:
    """records (of _PLACED) without their place. Gives each revisit the size of the payload of the response that it refers to; none if that is missing."""
    responses = records.filter("record_type = 'response'")
    whole = (
        responses.filter(F.col("payload_bytes") >= REVISIT_BYTES)
        .select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes")
        .dropDuplicates(["refers_to", "payload_digest"])
    )
    revisits = records.filter("record_type = 'revisit'").drop("payload_bytes")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    joined = salted_join(revisits, whole, ["refers_to", "payload_digest"], "at")
    lost = revisits.join(whole, ["refers_to", "payload_digest"], "left_anti").withColumn("payload_bytes", F.lit(None).cast("long"))
    return responses.select(*columns).unionByName(joined.select(*columns)).unionByName(lost.select(*columns))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record that the index lists."""
    # Stored, as revisits and the responses that they refer to come from the same pass over the archives.
    # A task for each archive: Spark would put so few rows into one.
    folder = shared_folder(manifest.sparkSession, folder)
    files = manifest.select("file").repartition(max(1, manifest.count()))
    return resolved(stored(files.mapInArrow(_read(folder), _PLACED), "records"))


def archived(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes and reads back; one row for each row of pages (page_id, url, html).

    Null html is an empty payload, a null url an empty key. A row without page_id revisits a response with an id,
    if there is one. Rows that repeat the largest page_id of a payload are all responses. No rows give no files
    and no rows; other columns are not read. Without `folder`, files go to the shared folder and stay till clear().
    """
    folder = folder or scratch(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)


def lookup(spark: SparkSession, folder: str, urls: list[str]) -> DataFrame:
    """url, page_id, record_type, refers_to, payload_digest, payload_bytes of all captures of the URLs.

    The manifest, one row for each archive, is bisected on the driver; blocks and records are read by tasks.
    """
    shards = sorted((r["first_key"], r["last_key"], r["file"]) for r in spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").collect())
    folder = shared_folder(spark, folder)
    wanted = []
    for url in urls:
        key = key_of(url)
        last = bisect_right(shards, key, key=lambda s: s[0])
        wanted += [(url, key, file) for _, most, file in shards[bisect_left(shards, key, key=lambda s: s[1]) : last] if most >= key]

    schema = f"url string, {_RECORD}"

    def find(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            out = []
            for url, key, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{root}/{name}.cdx") as of_index, fs.open_input_file(f"{root}/{name}") as archive:
                    for _, _, offset, length in Index(of_index).find(key):
                        archive.seek(offset)
                        out.append((url, *_row(archive.read(length))))
            yield _batch(schema, [pa.string(), *_RECORD_KINDS], out)

    return spark.createDataFrame(wanted, "url string, key string, file string").mapInArrow(find, schema)
