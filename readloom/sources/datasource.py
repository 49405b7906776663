"""``spark.read.format("sam")``: a Python data source that gives each file one partition for each byte range."""

from __future__ import annotations

import glob
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "rec_idx long, read_name string, flag int, ref_name string, pos0 int, mapq int, cigar string, mate_ref_name string, mate_pos0 int, insert_size int, seq string, qual string, tag_text string"


class Stretch(InputPartition):
    def __init__(self, number: int, path: str, begin: int, end: int):
        super().__init__(number)
        self.number, self.path, self.begin, self.end = number, path, begin, end


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = sorted(p for g in options["path"].split(",") for p in glob.glob(os.path.join(g, "*") if os.path.isdir(g) else g))
        self.size = int(options.get("splitBytes", 64 << 20))

    def partitions(self):
        out = []
        for p in self.paths:
            n = os.path.getsize(p)
            for b in range(0, max(n, 1), self.size):
                out.append(Stretch(len(out), p, b, min(b + self.size, n)))
        return out

    def read(self, part: Stretch):
        """Lines that begin in the stretch; rec_idx is the file's number and the line's first byte, so it rises in file order."""
        number = self.paths.index(part.path)
        with open(part.path, "rb") as f:
            f.seek(max(part.begin - 1, 0))
            if part.begin:
                f.readline()
            at = f.tell()
            while at < part.end and (line := f.readline()):
                text = line.decode().rstrip("\r\n")
                if text and not text.startswith("@"):
                    v = text.split("\t")
                    if len(v) < 11:
                        raise ValueError(f"{part.path}, byte {at}: {len(v)} columns")
                    mate = v[2] if v[6] == "=" else v[6]
                    yield (number << 44 | at, v[0], int(v[1]), v[2], int(v[3]) - 1, int(v[4]), v[5], mate, int(v[7]) - 1, int(v[8]), v[9], v[10], "\t".join(v[11:]))
                at = f.tell()


class SamSource(DataSource):
    """Options: path (files, folders or globs, comma-separated), splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "sam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options)


def register(spark) -> None:
    spark.dataSource.register(SamSource)
