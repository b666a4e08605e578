"""WARC archives with a two-level capture index.

Writing: each page becomes one gzip member with one WARC record; Spark's text
writer puts the members of a task into ``.warc.gz`` files of at most
``records_per_file`` records in the shared folder (the members are separated by
an empty gzip member, which readers of concatenated gzip skip).  Of records
with equal payloads of at least ``revisit_bytes`` bytes, the one with the
largest page id is a response and the others are revisits that refer to it.

Indexing: the archives are streamed once and each record gives a capture line:
the URL's key with the host reversed, the page id, file, offset and length.  The
lines are sorted over all partitions, cut into blocks of ``lines_per_block``
that are compressed, and a sparse directory keeps each block's first and last
key with their page ids, so that a capture lies in one block however many a URL
has.

Reading: each wanted capture finds its block by binary search in the directory,
blocks are decompressed once and searched by bisection, and the captures' byte
ranges are read file by file in tasks; neighbouring ranges are one read.  The
archives lie in the shared folder, which Python opens through Arrow's file
systems; in a store that these do not know Spark reads the files whole.

Defined results: a null payload is an empty one; a null URL has the empty key; a
page without an id is written without one and is never a response that others
refer to by number, so its equals without ids are all responses.  Equal URLs
are told apart by page id; rows repeated in id and URL are repeated records.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import default_parallelism, discard, materialize, pieces, scratch_path

#: A whole gzip member without content, as latin-1 text for the writer's separator.
EMPTY_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")
DATE = "2024-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, then path and query in lower case: ``com,example,www)/a?b``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return url.lower()
    if not host:
        return url.lower()
    labels = host.split(".")
    if labels[0] == "www" and len(labels) > 2:
        labels = labels[1:]
    key = ",".join(reversed(labels)) + (f":{port}" if port and port not in (80, 443) else "")
    return (key + ")" + (parts.path or "/") + ("?" + parts.query if parts.query else "")).lower()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block."""
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def members(stream, step: int = 1 << 16):
    """(offset, length, content) of the non-empty gzip members of an open file, of which one is in memory at a time."""
    at, held = 0, stream.read(step)
    while held:
        one, content, length = zlib.decompressobj(31), [], 0
        while not one.eof:
            if not held:
                raise ValueError("cut-off gzip member")
            content.append(one.decompress(held))
            length += len(held) - len(one.unused_data)
            held = one.unused_data if one.eof else stream.read(step)
        held = held or stream.read(step)
        body = b"".join(content)
        if body:
            yield at, length, body
        at += length


def _page_number(name: str) -> int | None:
    text = name.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = 1000, records_per_file: int = 2000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write ``pages`` as ``.warc.gz`` files under ``path``."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= revisit_bytes)
    # only payloads met more than once: the table that comes back to the pages is no larger than needed
    again = large.groupBy("digest").agg(F.max("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    again = materialize(again, "repeated-payloads")
    rows = rows.join(again, "digest", "left")
    refers = F.when((F.octet_length("payload") >= revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    rows = rows.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))

    def pack(batches):
        for batch in batches:
            for part in pieces(batch, 2):
                made = [gzip.compress(record(*x), 6, mtime=0) for x in zip(*(c.to_pylist() for c in part.columns))]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])

    packed = rows.mapInArrow(pack, "member binary").select(F.col("member").cast("string").alias("value"))
    packed.write.option("lineSep", EMPTY_MEMBER).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records_per_file).text(path)
    discard(again)


def archives(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    """``file`` of each archive and, where only Spark can open it or ``whole`` is set, its ``content``."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    content = F.col("content") if whole or not opens(path) else F.lit(None).cast("binary")
    return read.select(F.col("path").alias("file"), content.alias("content"))


def opens(path: str) -> bool:
    """Whether Arrow's file systems know the path's store."""
    try:
        pa.fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def opened(file: str, content: bytes | None = None):
    """The archive as a seekable file."""
    if content is not None:
        return io.BytesIO(content)
    if file.startswith(("file:", "/")):
        # Spark writes local URIs with one slash or three, and does not escape them
        return pa.fs.LocalFileSystem().open_input_file("/" + file.removeprefix("file:").lstrip("/"))
    system, name = pa.fs.FileSystem.from_uri(file)
    return system.open_input_file(name)


CAPTURES = "key string, page_id long, file string, offset long, length long"


def captures(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record in the archives, with where it stands."""

    def scan(batches):
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                with opened(file, content.as_py()) as stream:
                    for offset, length, raw in members(stream):
                        headers, _ = parse_record(raw)
                        rows.append((url_key(json.loads(f'"{headers["WARC-Target-URI"]}"')), _page_number(headers["WARC-Record-ID"]), file, offset, length))
                if rows:
                    key, page, files, offsets, lengths = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(page, pa.int64()), pa.array(files), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                        names=["key", "page_id", "file", "offset", "length"],
                    )

    return archives(spark, path).mapInArrow(scan, CAPTURES)


DIRECTORY = ("first_key", "first_id", "last_key", "last_id")


def _goal(key: str, page_id: int | None) -> tuple[str, bool, int]:
    """A capture's place in the order of the index: by key, then page id, null first."""
    return key, page_id is not None, page_id or 0


def build_index(spark: SparkSession, archive_path: str, index_path: str, lines_per_block: int = 3000) -> None:
    """Write ``blocks`` (number, first and last key and page id, compressed lines) and the ``directory`` under ``index_path``."""
    parts = default_parallelism(spark)
    rows = captures(spark, archive_path)
    # the page id and place break the ties of a key, so that one URL with very many captures is spread as well
    order = ["key", "page_id", "file", "offset"]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def pack(batches):
        import pyspark

        part = pyspark.TaskContext.get().partitionId()
        made, held = 0, []

        def block():
            nonlocal made
            lines = "\n".join(json.dumps(x) for x in held).encode()
            made += 1
            ends = [pa.array([x], kind) for line in (held[0], held[-1]) for x, kind in zip(line, (pa.string(), pa.int64()))]
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + made - 1], pa.int64()), *ends, pa.array([len(held)], pa.int64()), pa.array([zlib.compress(lines)], pa.binary())],
                names=["block", *DIRECTORY, "n", "body"],
            )

        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(x)
                if len(held) == lines_per_block:
                    yield block()
                    held = []
        if held:
            yield block()

    packed = rows.mapInArrow(pack, "block long, first_key string, first_id long, last_key string, last_id long, n long, body binary")
    packed.write.parquet(f"{index_path}/blocks")
    spark.read.parquet(f"{index_path}/blocks").select("block", *DIRECTORY, "n").write.parquet(f"{index_path}/directory")


def find_blocks(goals: list[tuple], firsts: list[tuple], lasts: list[tuple], numbers: list[int]):
    """For each capture the numbers of the blocks that may hold it, by bisection in the sorted directory.

    That is one, or for a record repeated in key and id those over which its repeats run.
    """
    for goal in goals:
        at = bisect_left(lasts, goal)
        found = []
        while at < len(firsts) and firsts[at] <= goal:
            found.append(numbers[at])
            at += 1
        yield found


def _places(lines: list[list]) -> pa.Table:
    key, page, file, offset, length = zip(*lines) if lines else ((),) * 5
    return pa.table({"key": pa.array(key, pa.string()), "page_id": pa.array(page, pa.int64()), "file": pa.array(file, pa.string()), "offset": pa.array(offset, pa.int64()), "length": pa.array(length, pa.int64())})


def locate(spark: SparkSession, wanted: DataFrame, index_path: str, entries_per_part: int = 100_000) -> DataFrame:
    """Captures of the keys in ``wanted`` (columns ``key``, ``page_id``), by two-level search.

    The directory is broadcast in runs of at most ``entries_per_part`` entries.
    """
    wanted = wanted.select("key", "page_id").distinct()
    directory = spark.read.parquet(f"{index_path}/directory")
    total = directory.count()
    schema = "key string, page_id long, block long"
    spread = None
    runs = max(1, -(-total // entries_per_part))
    for run in range(runs):
        mine = directory if runs == 1 else directory.where(F.pmod("block", F.lit(runs)) == run)
        entries = sorted((_goal(r["first_key"], r["first_id"]), _goal(r["last_key"], r["last_id"]), r["block"]) for r in mine.select("block", *DIRECTORY).collect())
        shared = spark.sparkContext.broadcast(tuple(list(x) for x in zip(*entries)) if entries else ([], [], []))

        def search(batches, shared=shared):
            firsts, lasts, numbers = shared.value
            for batch in batches:
                keys, ids = batch.column(0).to_pylist(), batch.column(1)
                hits = list(find_blocks([_goal(*x) for x in zip(keys, ids.to_pylist())], firsts, lasts, numbers))
                take = np.repeat(np.arange(len(keys)), [len(x) for x in hits])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), ids.take(pa.array(take)), pa.array([b for x in hits for b in x], pa.int64())], names=["key", "page_id", "block"])

        found = wanted.mapInArrow(search, schema)
        spread = found if spread is None else spread.unionByName(found)

    def bisect(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for body in right.column("body").to_pylist():
            lines = [json.loads(x) for x in zlib.decompress(body).split(b"\n")]
            places = [_goal(x[0], x[1]) for x in lines]
            for goal in (_goal(*x) for x in zip(left.column("key").to_pylist(), left.column("page_id").to_pylist())):
                at = bisect_left(places, goal)
                while at < len(places) and places[at] == goal:
                    out.append(lines[at])
                    at += 1
        return _places(out)

    blocks = spark.read.parquet(f"{index_path}/blocks").select("block", "body")
    return spread.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(bisect, CAPTURES)


READ = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, block binary"


#: Ranges of a file less than ``GAP`` bytes apart are read at once, up to about ``SPAN`` bytes.
GAP, SPAN = 1 << 16, 4 << 20


def spans(ranges: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Sorted (offset, length) ranges, those that are read at once together."""
    out: list[list[tuple[int, int]]] = []
    for offset, length in ranges:
        near = out and offset - sum(out[-1][-1]) < GAP and offset + length - out[-1][0][0] <= SPAN
        out[-1].append((offset, length)) if near else out.append([(offset, length)])
    return out


def _parsed(raw: bytes, with_block: bool) -> tuple:
    headers, block = parse_record(zlib.decompress(raw, 31))
    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and hashlib.sha1(block).hexdigest() != digest:
        raise ValueError(f"digest of {headers['WARC-Record-ID']} differs")
    size = len(block) if kind == "response" else int(headers["X-Payload-Length"])
    refers = headers.get("WARC-Refers-To")
    return _page_number(headers["WARC-Record-ID"]), json.loads(f'"{headers["WARC-Target-URI"]}"'), kind, digest, size, _page_number(refers) if refers else None, block if with_block else None


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split(" ")[0] for x in READ.split(", ")])


def read_ranges(spark: SparkSession, places: DataFrame, archive_path: str, with_block: bool = True, part_bytes: int = 128 << 20) -> DataFrame:
    """The records at ``places`` (file, offset, length), each range read from its archive and parsed."""
    if not opens(archive_path):
        return _cut_whole(spark, places, archive_path, with_block)
    size = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archive_path).agg(F.sum("length")).first()[0] or 0
    # by the bytes to read: the places alone are few, and adaptive execution would put them into one task
    parts = max(default_parallelism(spark), -(-size // part_bytes))
    sorted_ = places.select("file", "offset", "length").repartition(parts, "file").sortWithinPartitions("file", "offset")

    def read(batches):
        for batch in batches:
            files = batch.column(0).to_pylist()
            cuts = [i for i in range(len(files)) if i == 0 or files[i] != files[i - 1]] + [len(files)]
            offsets, lengths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in zip(cuts, cuts[1:]):
                with opened(files[a]) as stream:
                    for span in spans(list(zip(offsets[a:b], lengths[a:b]))):
                        first = span[0][0]
                        stream.seek(first)
                        data = stream.read(sum(span[-1]) - first)
                        yield _rows([_parsed(data[at - first : at - first + n], with_block) for at, n in span])

    return sorted_.mapInArrow(read, READ)


def _cut_whole(spark: SparkSession, places: DataFrame, archive_path: str, with_block: bool) -> DataFrame:
    """The same from files that only Spark can open."""
    by_file = places.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("ranges"))
    files = archives(spark, archive_path, whole=True).join(by_file, "file").select("content", "ranges")

    def cut(batches):
        for batch in batches:
            for data, ranges in zip(batch.column(0), batch.column(1).to_pylist()):
                data = data.as_py()
                for lo in range(0, len(ranges), 200):
                    yield _rows([_parsed(data[r["offset"] : r["offset"] + r["length"]], with_block) for r in ranges[lo : lo + 200]])

    return files.mapInArrow(cut, READ)


def with_key(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Columns ``key`` and ``page_id`` to look pages up by."""
    rows = pages.select(F.col(url_col).cast("string").alias("url"), F.col(id_col).cast("long").alias("page_id"))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column(0).to_pylist()], pa.string()), batch.column(1)], names=["key", "page_id"])

    return rows.mapInArrow(run, "key string, page_id long")


def lookup(spark: SparkSession, urls: list[str], archive_path: str, index_path: str) -> DataFrame:
    """All captures of the URLs, as :func:`read_ranges` gives them: the directory names the blocks, these the byte ranges."""
    keys = sorted({url_key(u) for u in urls})
    wanted = spark.createDataFrame([(k,) for k in keys], "key string")
    directory = spark.read.parquet(f"{index_path}/directory")
    numbers = directory.join(F.broadcast(wanted), F.col("key").between(F.col("first_key"), F.col("last_key")), "left_semi").select("block")
    blocks = spark.read.parquet(f"{index_path}/blocks").select("block", "body").join(numbers, "block", "left_semi")

    def search(batches):
        for batch in batches:
            for body in batch.column(1).to_pylist():
                lines = [json.loads(x) for x in zlib.decompress(body).split(b"\n")]
                own, found = [x[0] for x in lines], []
                for key in keys:
                    found += lines[bisect_left(own, key) : bisect_right(own, key)]
                yield from _places(found).to_batches()

    return read_ranges(spark, blocks.mapInArrow(search, CAPTURES), archive_path)


def round_trip(pages: DataFrame, revisit_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", with_block: bool = False) -> DataFrame:
    """Write all pages, index the archives, look every page up and return the records read."""
    spark = pages.sparkSession
    base = scratch_path(spark, "warc")
    write_archives(pages, f"{base}/archives", revisit_bytes, id_col=id_col, url_col=url_col, html_col=html_col)
    build_index(spark, f"{base}/archives", f"{base}/index")
    places = locate(spark, with_key(pages, id_col, url_col), f"{base}/index")
    return read_ranges(spark, places, f"{base}/archives", with_block)
