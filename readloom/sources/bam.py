"""BAM files: a scan by record-aligned stretches of the compressed file, and a sink of one file for each partition.

Files are opened through pyarrow's file systems by the executors, so they must be in a store that all of them reach.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tags as tg
from .sam import lines as sam_lines

# Fixed values of the public SAM/BAM specification.
MAGIC = b"BAM\x01"
CIGAR = "MIDNSHP=X"
SEQ = "=ACMGRSVTWYHKDBN"
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
INTS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I"}

#: Bytes of a block before compression.
BLOCK = 0xFF00
COLUMNS = "rec_idx long, read_name string, flag int, ref_id int, pos0 int, mapq int, cigar string, mate_ref_id int, mate_pos0 int, insert_size int, seq string, qual string, tag_text string"
HEAD = "<iiBBHHHiiii"


def _open(uri: str):
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


#: What reading a damaged block or record raises.
BROKEN = (ValueError, KeyError, IndexError, zlib.error, struct.error)
START = b"\x1f\x8b\x08\x04"


def plausible(data: bytes, at: int, n_refs: int, following: int = 1) -> bool:
    """A record can start at this place of a block: references, positions and lengths agree, and so they do where the next would start."""
    if at + 36 > len(data):
        return False
    size, ref, pos, name_n, _, _, ops, _, n, mate_ref, mate_pos, _ = struct.unpack_from("<i" + HEAD[1:], data, at)
    known = -1 <= ref < n_refs and -1 <= mate_ref < n_refs and pos >= -1 and mate_pos >= -1
    if not (known and name_n > 1 and n >= 0 and 32 + name_n + 4 * ops + (n + 1) // 2 + n <= size < 1 << 24):
        return False
    name = data[at + 36 : at + 36 + name_n]
    if len(name) == name_n and (name[-1] or not all(32 < c < 127 for c in name[:-1])):
        return False
    after = at + 4 + size
    return following == 0 or after + 36 > len(data) or plausible(data, after, n_refs, following - 1)


class Blocks:
    """Reads a BGZF file from a virtual offset (file offset of a block << 16 | offset in its content) on.

    With ``n_refs`` a damaged start is passed over.
    """

    def __init__(self, stream, at: int = 0, n_refs: int | None = None):
        self.stream, self.next, self.block, self.data, self.place = stream, at >> 16, at >> 16, b"", 0
        self.size = stream.size()
        try:
            self._fill()
            self.place = at & 0xFFFF
        except BROKEN:
            if n_refs is None:
                raise
            self.resync(n_refs)

    def resync(self, n_refs: int) -> bool:
        """Go to the first plausible record of the next whole block; False (and at the end) if there is none."""
        at = self.next
        while (at := self._find(at)) is not None:
            self.next = at
            try:
                filled = self._fill()
            except BROKEN:
                at += 1
                continue
            if not filled:
                break
            for place in range(len(self.data)):
                if plausible(self.data, place, n_refs):
                    self.place = place
                    return True
            at = self.next
        self.next, self.data, self.place = self.size, b"", 0
        return False

    def _find(self, at: int) -> int | None:
        """The next place from ``at`` on where a block may start."""
        while at < self.size:
            part = self.stream.read_at(1 << 16, at)
            if (i := part.find(START)) >= 0:
                return at + i
            at += max(len(part) - len(START) + 1, 1)
        return None

    def _fill(self) -> bool:
        while self.next < self.size:
            head = self.stream.read_at(18, self.next)
            if head[:4] != START:
                raise ValueError(f"no block of a BAM file at byte {self.next}")
            extra = struct.unpack_from("<H", head, 10)[0]
            fields, n = self.stream.read_at(extra, self.next + 12), 0
            while fields[n : n + 2] != b"BC":
                n += 4 + struct.unpack_from("<H", fields, n + 2)[0]
            size = struct.unpack_from("<H", fields, n + 4)[0] + 1
            self.block, self.data, self.place = self.next, zlib.decompress(self.stream.read_at(size, self.next), 31), 0
            self.next += size
            if self.data:
                return True
        return False

    def tell(self) -> int | None:
        """Where the next byte is; None at the end."""
        if self.place >= len(self.data) and not self._fill():
            return None
        return self.block << 16 | self.place

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.place >= len(self.data) and not self._fill():
                raise ValueError("the file ends within a record")
            part = self.data[self.place : self.place + n - len(out)]
            self.place += len(part)
            out += part
        return out


def read_header(b: Blocks) -> tuple[str, list[tuple[str, int]]]:
    if b.read(4) != MAGIC:
        raise ValueError("not a BAM file")
    (n,) = struct.unpack("<i", b.read(4))
    text = b.read(n).rstrip(b"\x00").decode()
    refs = []
    for _ in range(struct.unpack("<i", b.read(4))[0]):
        (n,) = struct.unpack("<i", b.read(4))
        name = b.read(n)[:-1].decode()
        refs.append((name, struct.unpack("<i", b.read(4))[0]))
    return text, refs


def _number(v: float) -> str:
    return f"{v:.6g}"


def decode_tags(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in INTS:
            f = INTS[kind]
            out.append(f"{name}:i:{struct.unpack_from(f, raw, at)[0]}")
            at += struct.calcsize(f)
        elif kind == "A":
            out.append(f"{name}:A:{chr(raw[at])}")
            at += 1
        elif kind == "f":
            out.append(f"{name}:f:{_number(struct.unpack_from('<f', raw, at)[0])}")
            at += 4
        elif kind in "ZH":
            end = raw.index(b"\x00", at)
            out.append(f"{name}:{kind}:{raw[at:end].decode()}")
            at = end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            f = "<f" if sub == "f" else INTS[sub]
            at += 5
            v = [struct.unpack_from(f, raw, at + i * struct.calcsize(f))[0] for i in range(n)]
            out.append(f"{name}:B:{sub}," + ",".join(_number(x) if sub == "f" else str(x) for x in v))
            at += n * struct.calcsize(f)
        else:
            raise ValueError(f"tag {name} has the unknown type {kind}")
    return "\t".join(out)


def encode_tags(text: str) -> bytes:
    out = b""
    for t in filter(None, (text or "").split("\t")):
        name, kind, v = t[:2].encode(), t[3], t[5:]
        if kind == "i":
            out += name + (b"i" + struct.pack("<i", int(v)) if int(v) < 1 << 31 else b"I" + struct.pack("<I", int(v)))
        elif kind == "A":
            out += name + b"A" + v.encode()
        elif kind == "f":
            out += name + b"f" + struct.pack("<f", float(v))
        elif kind == "B":
            sub, *items = v.split(",")
            f = "<f" if sub == "f" else INTS[sub]
            out += name + b"B" + sub.encode() + struct.pack("<i", len(items)) + b"".join(struct.pack(f, float(x) if sub == "f" else int(x)) for x in items)
        else:
            out += name + kind.encode() + v.encode() + b"\x00"
    return out


def decode(raw: bytes) -> tuple:
    ref, pos, name_n, mapq, _, ops, flag, n, mate_ref, mate_pos, size = struct.unpack_from(HEAD, raw)
    at = struct.calcsize(HEAD)
    name = raw[at : at + name_n - 1].decode()
    at += name_n
    cigar = "".join(f"{v >> 4}{CIGAR[v & 15]}" for v in struct.unpack_from(f"<{ops}I", raw, at)) or "*"
    at += 4 * ops
    packed = raw[at : at + (n + 1) // 2]
    seq = "".join(SEQ[b >> 4] + SEQ[b & 15] for b in packed)[:n] or "*"
    at += (n + 1) // 2
    q = raw[at : at + n]
    qual = "*" if not q or q[0] == 0xFF else "".join(chr(x + 33) for x in q)
    return name, flag, ref, pos, mapq, cigar, mate_ref, mate_pos, size, seq, qual, decode_tags(raw[at + n :])


def _bin(start: int, end: int) -> int:
    """The smallest index bin (of 16 kb to 512 Mb) that holds [start, end)."""
    end -= 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return first + (start >> shift)
    return 0


def encode(name, flag, ref, pos, mapq, cigar, mate_ref, mate_pos, size, seq, qual, tag_text) -> bytes:
    import re

    ops = [(int(n), o) for n, o in re.findall("([0-9]+)([MIDNSHP=X])", cigar)]
    span = sum(n for n, o in ops if o in "MDN=X") or 1
    s = "" if seq == "*" else seq
    codes = [max(SEQ.find(c), 0) if c == "=" else (SEQ.find(c.upper()) if c.upper() in SEQ else 15) for c in s] + [0] * (len(s) % 2)
    body = struct.pack(HEAD, ref, pos, len(name) + 1, mapq, _bin(max(pos, 0), max(pos, 0) + span), len(ops), flag, len(s), mate_ref, mate_pos, size) + name.encode() + b"\x00"
    body += b"".join(struct.pack("<I", n << 4 | CIGAR.index(o)) for n, o in ops) + bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    body += (b"\xff" * len(s) if qual == "*" else bytes(ord(c) - 33 for c in qual)) + encode_tags(tag_text)
    return struct.pack("<i", len(body)) + body


def _block(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    inner = z.compress(data) + z.flush()
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(inner) + 25) + inner + struct.pack("<II", zlib.crc32(data), len(data))


def header(spark: SparkSession, path: str, require_eof: bool = True) -> tuple[str, list[tuple[str, int]], int]:
    """(text, references, virtual offset of the first record) of one file; without its closing block it counts as cut off."""
    system, at = _open(path)
    with system.open_input_file(at) as f:
        if require_eof and (f.size() < len(EOF) or f.read_at(len(EOF), f.size() - len(EOF)) != EOF):
            raise ValueError(f"{path} has no closing block; pass require_eof=False if it is whole")
        b = Blocks(f)
        text, refs = read_header(b)
        first = b.tell()
        return text, refs, -1 if first is None else first


def starts(index: bytes, every: int = 64 << 20) -> list[int]:
    """Virtual offsets of records, at least ``every`` compressed bytes apart, from a BAM index."""
    at, found = 8, set()
    for _ in range(struct.unpack_from("<i", index, 4)[0]):
        (bins,), at = struct.unpack_from("<i", index, at), at + 4
        for _ in range(bins):
            number, n = struct.unpack_from("<Ii", index, at)
            at += 8
            if number != 37450:
                found.update(struct.unpack_from("<Q", index, at + 16 * i)[0] for i in range(n))
            at += 16 * n
        (n,), at = struct.unpack_from("<i", index, at), at + 4
        at += 8 * n
    out: list[int] = []
    for v in sorted(found):
        if not out or (v >> 16) - (out[-1] >> 16) >= every:
            out.append(v)
    return out


def read(spark: SparkSession, path: str, *, index: str | None = None, splits: list[int] | None = None, require_eof: bool = True, recover: bool = False) -> tuple[DataFrame, str, DataFrame]:
    """(records, header text, references) of one BAM file.

    With ``recover``, damaged blocks and records are passed over; reading goes on at the next record that looks whole.
    With its index (or virtual offsets of records in ``splits``) the file is read in stretches, each by a task; without, by
    one. rec_idx is a record's virtual offset, so it rises in file order.
    """
    text, refs, first = header(spark, path, require_eof)
    if index is not None:
        system, at = _open(index)
        with system.open_input_file(at) as f:
            splits = starts(f.read())
    cuts = sorted({first, *[s for s in splits or [] if s > first]}) if first >= 0 else []
    parts = [(a, b) for a, b in zip(cuts, [*cuts[1:], 1 << 62], strict=True)]

    n_refs = len(refs) if recover else None

    def step(blocks: Blocks, b: int) -> tuple | None:
        """The next record, None at the end of the stretch."""
        while True:
            try:
                v = blocks.tell()
                return None if v is None or v >= b else (v, *decode(blocks.read(struct.unpack("<i", blocks.read(4))[0])))
            except BROKEN:
                if n_refs is None:
                    raise
                blocks.resync(n_refs)

    def run(batches):
        for pdf in batches:
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                system, at = _open(path)
                with system.open_input_file(at) as f:
                    blocks, rows = Blocks(f, int(a), n_refs), []
                    while (row := step(blocks, int(b))) is not None:
                        rows.append(row)
                        if len(rows) == 20_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=names)

    names = [c.split()[0] for c in COLUMNS.split(", ")]
    if not parts:
        records = spark.createDataFrame([], COLUMNS)
    else:
        records = spark.createDataFrame(parts, "a long, b long").repartition(len(parts), "a").mapInPandas(run, COLUMNS)
    table = spark.createDataFrame([(i, n, size) for i, (n, size) in enumerate(refs)], "ref_id int, name string, length int")
    # The dictionary is in the header, which the driver holds already.
    names_of = lambda a, b: F.broadcast(table.select(F.col("ref_id").alias(a), F.col("name").alias(b)))
    full = records.join(names_of("ref_id", "ref_name"), "ref_id", "left").join(names_of("mate_ref_id", "mate_ref_name"), "mate_ref_id", "left")
    full = full.withColumns({"ref_name": F.coalesce("ref_name", F.lit("*")), "mate_ref_name": F.coalesce("mate_ref_name", F.lit("*")), "tags": tg.parse(F.split("tag_text", "\t"))}).drop("tag_text")
    return full, text, table


def write(reads: DataFrame, text: str, refs: list[tuple[str, int]], folder: str, *, level: int = 6) -> list[str]:
    """One BAM file for each partition of ``reads``, in its order; level 0 is uncompressed. Returns the files of tasks that ended."""
    top = MAGIC + struct.pack("<i", len(text.encode())) + text.encode() + struct.pack("<i", len(refs)) + b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\x00" + struct.pack("<i", size) for n, size in refs)
    columns = ["read_name", "flag", "ref_id", "pos0", "mapq", "cigar", "mate_ref_id", "mate_pos0", "insert_size", "seq", "qual"]

    def run(batches):
        sink, held, path = None, bytearray(top), f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.bam"
        for pdf in batches:
            if sink is None:
                system, at = _open(path)
                system.create_dir(at.rpartition("/")[0], recursive=True)
                sink = system.open_output_stream(at, compression=None)
            for row in pdf.itertuples(index=False):
                held += encode(*row)
                while len(held) >= BLOCK:
                    sink.write(_block(bytes(held[:BLOCK]), level))
                    del held[:BLOCK]
        if sink is not None:
            if held:
                sink.write(_block(bytes(held), level))
            sink.write(EOF)
            sink.close()
            yield pd.DataFrame({"path": [path]})

    own = reads.select(*columns, tg.text(F.col("tags")).alias("tag_text"))
    return sorted(r.path for r in own.mapInPandas(run, "path string").collect())


def to_sam(reads: DataFrame) -> DataFrame:
    """rec_idx, value: the records as SAM text."""
    return sam_lines(reads)
