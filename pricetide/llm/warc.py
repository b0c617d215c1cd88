"""Deterministic sharded WARC archives of web pages, and their reader.

Shards are ranges of page_id: sizes summed over at most CELLS equal ranges (a table of fixed size, sent to all tasks) give boundaries that
depend on the data alone, so the same pages give the same files, byte for byte. Pages become gzip members in map tasks and are shuffled
once, to their shard. A shard is sorted by page_id and digest and rolls to its next file when one has ROLL_BYTES; short marks sorted before
their page tell which pages are revisits. Files are written by Spark's text writer, whose tasks commit under temporary names: every member ends
in a zero byte (an empty member follows one that doesn't), which is the writer's line end. The driver then moves files to their names and
writes the manifest last; readers take only what a manifest lists, so an interrupted write is never seen.

Of pages with equal payloads of LEAST_BYTES or more, that with the smallest page_id is a response and the others revisit it. Join keys are
digests, whose smallest page ids are combined before the shuffle; a payload that a third of the pages share is a skewed key of a plain
join of ids and digests, which adaptive execution splits.

Defined results: a null html is an empty payload; a null page_id sorts first, comes back as null, and is never referred to; pages with the
smallest id of their payload are all responses when that id repeats; a null url gets a urn; no pages give no files and no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm.common import checkpoint_folder, cut, table

ROLL_BYTES = 32 << 20
#: Payload bytes of a shard.
SHARD_BYTES = 96 << 20
LEAST_BYTES = 100
#: Equal ranges of page_id over which sizes are summed to place shard boundaries.
CELLS = 1 << 16
DATE = "2024-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: A gzip member without content; like any member under 16 MiB it ends in a zero byte.
EMPTY = bytes.fromhex("1f8b080000000000000303000000000000000000")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def member(raw: bytes) -> bytes:
    """raw as gzip member(s) without a time stamp, ending in a zero byte."""
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    out = squeeze.compress(raw) + squeeze.flush()
    out = out[:9] + b"\xff" + out[10:]
    return out if out[-1] == 0 else out + EMPTY


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def record(kind: str, fields: dict[str, object], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Date": DATE} | fields
    head |= {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": len(block)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def page_fields(page_id: int | None, url: str | None, digest: str, size: int) -> dict[str, object]:
    target = "".join(url.split()) if url and url.strip() else f"urn:page:{page_id}"
    return {
        "WARC-Record-ID": record_id(page_id, digest), "WARC-Target-URI": target, "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha256:{digest}", "X-Page-Id": page_id, "X-Payload-Length": size,
    }


class Shards:
    """Shards of page ids, from sizes summed over equal ranges of ids; a null id is before all others."""

    def __init__(self, sizes: DataFrame, shard_bytes: int, cells: int = CELLS):
        low, high = sizes.agg(F.min("page_id"), F.max("page_id")).first()
        self.low, self.step = low or 0, max(1, -(-((high or 0) - (low or 0) + 1) // cells))
        cell = F.coalesce(F.floor((F.col("page_id") - self.low) / self.step) + 1, F.lit(0)).cast("int")
        sums = np.zeros(cells + 2, np.int64)
        for row in sizes.groupBy(cell.alias("cell")).agg(F.sum("size").alias("bytes")).collect():  # at most cells + 1 rows
            sums[row.cell] = row.bytes
        self.shard = (np.cumsum(sums) - sums) // shard_bytes

    def of(self, page_id: int | None) -> int:
        return int(self.shard[0 if page_id is None else (page_id - self.low) // self.step + 1])


PACKED = "shard int, page_id long, url string, digest string, size long, first long, packed binary"


def packer(shards: Shards):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(page_id, url, digest, payload) with the page's response record as packed."""
        for batch in batches:
            ids, urls, digests, payloads = (x.to_pylist() for x in batch.columns)
            packed = [member(record("response", page_fields(i, u, d, len(p)), HTTP + p)) for i, u, d, p in zip(ids, urls, digests, payloads, strict=True)]
            own = pa.array([shards.of(i) for i in ids], pa.int32())
            sizes = pa.array(map(len, payloads), pa.int64())
            yield pa.RecordBatch.from_arrays([own, *batch.columns[:3], sizes, pa.nulls(len(ids), pa.int64()), pa.array(packed, pa.binary())], names=["shard", "page_id", "url", "digest", "size", "first", "packed"])

    return pack


def marker(shards: Shards):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(page_id, digest, first) as rows like those of packer, without a record."""
        for batch in batches:
            n = batch.num_rows
            own = pa.array([shards.of(i) for i in batch.column(0).to_pylist()], pa.int32())
            columns = [own, batch.column(0), pa.nulls(n, pa.string()), batch.column(1), pa.nulls(n, pa.int64()), batch.column(2), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "page_id", "url", "digest", "size", "first", "packed"])

    return mark


def filer(roll: int):
    """Gives rows of sorted shards their files; a file begins with a warcinfo record."""

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, used, seq, marked, refers = None, 0, 0, 0, None, None
        for batch in batches:
            files, seqs, members = [], [], []
            for of, page_id, url, digest, size, first, packed in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if packed is None:
                    marked, refers = (page_id, digest), first
                    continue
                if marked == (page_id, digest):
                    first = refers
                    fields = page_fields(page_id, url, digest, size) | {"WARC-Refers-To": record_id(first, digest), "WARC-Profile": PROFILE, "X-Refers-To-Page-Id": first}
                    packed = member(record("revisit", fields, HTTP))
                if of != shard:
                    shard, number, used = of, 0, 0
                elif used + len(packed) > roll:
                    number, used = number + 1, 0
                name = f"{shard:08d}-{number:04d}"
                if used == 0:
                    info = f"software: page archive\r\nformat: WARC File Format 1.1\r\nshard: {name}\r\n".encode()
                    start = member(record("warcinfo", {"WARC-Record-ID": record_id(None, name), "Content-Type": "application/warc-fields"}, info))
                    files, seqs, members, used, seq = [*files, name], [*seqs, seq], [*members, start[:-1]], used + len(start), seq + 1
                files.append(name)
                seqs.append(seq)
                members.append(packed[:-1])
                used, seq = used + len(packed), seq + 1
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(seqs, pa.int64()), pa.array(members, pa.binary())], names=["file", "seq", "member"])

    return filed


def write_archives(pages: DataFrame, folder: str, roll: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES) -> str:
    """Writes (page_id, url, html) as archives below folder and returns the manifest's path."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.sha2(payload, 256).alias("digest"), payload.cast("binary").alias("payload"))
    narrow = cut(rows.select("page_id", "digest", F.octet_length("payload").cast("long").alias("size")))
    firsts = narrow.where(F.col("size") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    marks = narrow.join(firsts.select("digest", "first"), "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first")
    shards = Shards(narrow, shard_bytes)
    both = rows.mapInArrow(packer(shards), PACKED).unionByName(marks.mapInArrow(marker(shards), PACKED))
    ordered = both.repartition("shard").sortWithinPartitions("shard", "page_id", "digest", F.col("packed").isNotNull(), "url")
    filed = ordered.mapInArrow(filer(roll), "file string, seq long, member binary").sortWithinPartitions("file", "seq")
    staged, final = f"{folder}/staged", f"{folder}/archives"
    filed.select("file", F.col("member").cast("string").alias("member")).write.option("lineSep", "\0").partitionBy("file").text(staged)

    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(final))
    for shard in files.listStatus(path(staged)):
        if (name := shard.getPath().getName()).startswith("file="):
            (only,) = [x.getPath() for x in files.listStatus(shard.getPath()) if x.getPath().getName().startswith("part-")]
            if not files.rename(only, path(f"{final}/{name[5:]}.warc.gz")):
                raise OSError(f"{name} can't be moved to its name")
    files.delete(path(staged), True)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(final).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    listed.write.parquet(f"{folder}/manifest")
    return f"{folder}/manifest"


def members(data: bytes) -> Iterator[bytes]:
    """Contents of the gzip members of data."""
    view, at = memoryview(data), 0
    while at < len(data):
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            chunk = view[at : at + (1 << 16)]
            if not len(chunk):
                raise ValueError("an archive ends inside a member")
            parts.append(inflate.decompress(chunk))
            at += len(chunk) - len(inflate.unused_data)
        if raw := b"".join(parts):
            yield raw


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; the block's digest is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n" or f"sha256:{hashlib.sha256(block).hexdigest()}" != fields["WARC-Block-Digest"]:
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return fields, block


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def reader(with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for fields, block in map(parsed, members(data.as_py())):
                    if (kind := fields["WARC-Type"]) == "warcinfo":
                        continue
                    payload = block.partition(b"\r\n\r\n")[2]
                    size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response":
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    if f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
                        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
                    rows.append((number(fields.get("X-Page-Id")), fields["WARC-Target-URI"], size, digest, kind, number(fields.get("X-Refers-To-Page-Id")), payload if with_payload and kind == "response" else None))
                    if len(rows) == 256:
                        yield out(rows)
                        rows = []
                yield out(rows)

    return read


def read_archives(spark: SparkSession, manifest: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives that a manifest lists; digests are computed again and compared."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")  # files, one at a time
    folder = manifest.rpartition("/")[0]
    listed = spark.read.parquet(manifest)
    if listed.isEmpty():
        return spark.createDataFrame([], READ)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{folder}/archives")
    found = found.withColumn("name", F.element_at(F.split("path", "/"), -1)).join(listed.select("name"), "name", "left_semi")
    return found.select("content").mapInArrow(reader(with_payload), READ)


def op5_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/warc-{uuid.uuid4()}"
    manifest = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_archives(spark, manifest).drop("url", "payload")


OP5_SQL = f"""
with sized as (
  select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), firsts as (
  select *, case when payload_bytes >= {LEAST_BYTES} then min(page_id) over (partition by payload_digest) end as least from sized
)
select page_id, payload_bytes, payload_digest, case when page_id is distinct from coalesce(least, page_id) then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from coalesce(least, page_id) then least end as refers_to
from firsts
"""
