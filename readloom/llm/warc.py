"""WARC archives: written as whole-file gzip streams, normalised to one member for each record, read back by offset (operator 10)."""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, words

#: Payloads of fewer bytes are never revisits.
MIN_PAYLOAD = 100
LEVEL = 4
READ = 1 << 20
#: Bytes of payload that a writing task holds as objects, bytes inflated at a time, and bytes of records that a reading task fetches.
SLICE, INFLATED, FETCH = 8 << 20, 16 << 20, 32 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "path string, offset long, length long"


def _open(uri: str):
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _line(value: str | None) -> str:
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit that names the response's page and has none."""
    where = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}>"
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", where), ("WARC-Date", DATE), ("WARC-Target-URI", _line(url)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block = http + payload
    else:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        block = http
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def records(chunks):
    """Split a stream of inflated bytes into whole records; a record that is cut off or malformed is an error."""
    held = bytearray()
    chunks = iter(chunks)
    begun = 0

    def more() -> bool:
        nonlocal begun
        if begun:
            del held[:begun]
            begun = 0
        for c in chunks:
            if c:
                held.extend(c)
                return True
        return False

    while True:
        while (end := held.find(b"\r\n\r\n", begun)) < 0:
            if not more():
                if len(held) > begun:
                    raise ValueError("the archive ends within a record's header")
                return
        head = bytes(held[begun:end])
        size = next((int(x.split(b":", 1)[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
        if size is None or not head.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {head[:60]!r}")
        need = end - begun + 4 + size + 4
        while len(held) - begun < need:
            if not more():
                raise ValueError("the archive ends within a record")
        yield bytes(held[begun : begun + need])
        begun += need


def inflated(stream):
    """The bytes of a gzip stream, member after member, without holding the whole; a stream that stops within a member is an error."""
    z, inside = zlib.decompressobj(31), True
    while data := stream.read(READ):
        while data:
            yield z.decompress(data, INFLATED)
            inside = not z.eof
            data = z.unused_data if z.eof else z.unconsumed_tail
            if z.eof:
                z = zlib.decompressobj(31)
    while inside and (rest := z.decompress(z.unconsumed_tail, INFLATED)):
        yield rest
        inside = not z.eof
    if inside:
        raise ValueError("the archive ends within a gzip member")


def fields(rec: bytes) -> tuple[dict[str, str], bytes]:
    head, _, block = rec.partition(b"\r\n\r\n")
    got = {}
    for x in head.split(b"\r\n")[1:]:
        k, _, v = x.partition(b":")
        got[k.decode().lower()] = v.strip().decode()
    return got, block[:-4]


def decided(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """page_id, url, payload, digest, and refers_to: of equal payloads of ``min_payload`` bytes or more, all but the one with the smallest id refer to that.

    Smaller payloads, whose digests many pages may share, take no part in the join. Its small side is a table of its own, so
    that Spark can split a page that very many rows hold.
    """
    payload = F.coalesce(F.col(f"`{html}`").cast("binary"), F.lit("").cast("binary"))
    all_ = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), payload.alias("payload"))
    big = F.octet_length("payload") >= min_payload
    small = all_.filter(~big).select("*", F.sha2("payload", 256).alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    large = all_.filter(big).withColumn("digest", F.sha2("payload", 256))
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    first = store.keep(first.select(F.col("digest").alias("_d"), "first"), "warc-first")
    joined = large.join(first, large["digest"] == first["_d"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")).unionByName(small)


def write(pages: DataFrame, folder: str, **options) -> DataFrame:
    """Write each partition as one archive, a single gzip stream over all its records; returns the archives' paths.

    A task that is run again writes another file, and only files of tasks that ended are listed.
    """

    def run(batches):
        n, target, sink, z, path = 0, None, None, None, f"{folder}/raw-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        for b in words.sliced(batches, "payload", SLICE):
            for p, u, payload, d, r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if sink is None:
                    target, at = _open(path)
                    target.create_dir(at.rpartition("/")[0], recursive=True)
                    sink, z = target.open_output_stream(at, compression=None), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                sink.write(z.compress(record(p, u, payload, d, r)))
                n += 1
        if sink is not None:
            sink.write(z.flush())
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": pa.array([n], pa.int64())})

    return store.keep(decided(pages, **options).mapInArrow(run, "path string, records long"), "warc-written")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Inflate each archive's stream once, write every record as a gzip member of its own, and an offset index beside the archive.

    ``archives`` has the paths of gzip archives (one stream or many members), and may have ``records``, the number that each
    must hold. Every archive is a task of its own. A stream that is cut, a malformed record or another number of records is an
    error. Returns path (the new archive), index, records and bytes.
    """
    known = "records" in archives.columns

    def run(batches):
        for b in batches:
            for path, due in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                name = f"{folder}/members-{uuid.uuid4().hex}.warc.gz"
                source, at = _open(path)
                target, to = _open(name)
                target.create_dir(to.rpartition("/")[0], recursive=True)
                offset, n = 0, 0
                with source.open_input_stream(at, compression=None) as stream, target.open_output_stream(to, compression=None) as sink, target.open_output_stream(to + ".idx", compression=None) as index:
                    for rec in records(inflated(stream)):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(rec) + z.flush()
                        sink.write(member)
                        index.write(f"{name}\t{offset}\t{len(member)}\n".encode())
                        offset += len(member)
                        n += 1
                if due is not None and n != due:
                    raise ValueError(f"{path} has {n} records, {due} were written")
                yield pa.RecordBatch.from_pydict({"path": [name], "index": [name + ".idx"], "records": pa.array([n], pa.int64()), "bytes": pa.array([offset], pa.int64())})

    given = archives.select("path", (F.col("records") if known else F.lit(None)).cast("long").alias("records"))
    spread = given.repartition(max(1, archives.count()), "path")  # a number, so that these few rows aren't put in one task
    return store.keep(spread.mapInArrow(run, "path string, index string, records long, bytes long"), "warc-members")


def read(index: DataFrame) -> DataFrame:
    """Fetch each indexed record by its offset, inflate its member alone, and check a response's payload against its digest."""

    def run(batches):
        last, stream = None, None
        for b in batches:
            out = {"page_id": [], "url": [], "payload_bytes": [], "payload_digest": [], "record_type": [], "refers_to": []}
            for path, offset, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if path != last:
                    source, at = _open(path)
                    last, stream = path, source.open_input_file(at)
                got, block = fields(zlib.decompress(stream.read_at(length, offset), 31))
                digest, size = got["warc-payload-digest"].removeprefix("sha256:"), int(got["x-payload-length"])
                kind = got["warc-type"]
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    size = len(payload)
                    if (found := hashlib.sha256(payload).hexdigest()) != digest:
                        raise ValueError(f"{path} at {offset}: payload {found}, digest {digest}")
                page = lambda v: int(v[10:-1]) if v and v.startswith("<urn:page:") else None
                for k, v in zip(out, (page(got["warc-record-id"]), got.get("warc-target-uri"), size, digest, kind, page(got.get("warc-refers-to"))), strict=True):
                    out[k].append(v)
            types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(v, types.get(k, pa.string())) for k, v in out.items()], names=list(out))

    return index.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, *, folder: str | None = None, **options) -> DataFrame:
    """Write ``pages`` as WARC archives, normalise them, and read every record back by the sidecar index.

    A null html is an empty payload; a null id gets a record without one, and never is what others revisit unless no row of
    the payload has an id, in which case all are responses; a row repeated with its id is a response each time, if its id is
    the smallest. An empty table gives no archives and no rows.
    """
    spark = pages.sparkSession
    folder = folder or store.new_path(spark, "warc")
    written = write(pages, f"{folder}/raw", **options)
    members = normalise(written, f"{folder}/members")
    n, size = members.agg(F.sum("records"), F.sum("bytes")).first()
    store.drop(spark, f"{folder}/raw", written)
    if not n:
        return read(spark.createDataFrame([], INDEX))
    index = spark.read.schema(INDEX).csv(f"{folder}/members/*.idx", sep="\t", quote="").join(members.select("path"), "path", "left_semi")
    if (found := index.count()) != n:
        raise ValueError(f"the indexes list {found} records, {n} were written")
    parts = max(spark.sparkContext.defaultParallelism, -(-size // FETCH))
    return read(index.repartitionByRange(parts, "path", "offset").sortWithinPartitions("path", "offset"))
