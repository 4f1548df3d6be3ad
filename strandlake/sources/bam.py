"""SRC-16: binary alignments (BAM) as a data source `reads`, by region with an index.

Columns are those of readers.alignments, so that pileup takes both. With an index (.bai or .csi beside the file) a file is cut into
tasks at offsets where the index says that records begin, and a region reads only the members that the index names. A
file without an index is one task, as records can't be found from within. Filters on chrom and pos, and option `region`, are
pushed to the index; Spark applies filters again. A file that ends within a record is an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter

from . import bgzf
from .calls import BATCH, SPLIT, Piece, Pushed, cut, indexed, registered
from .readers import Region, parse_region

SCHEMA = "read_id string, flags int, chrom string, pos long, mapq int, mate_chrom string, mate_pos long, len long, bases string, quals string, cigar string"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[x.split()[1]] for x in SCHEMA.split(", ")]
# Codes of bases (four bits) and of CIGAR operations; those that cover the reference.
BASES, OPERATIONS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
COVERING = {OPERATIONS.index(x) for x in "MDN=X"}
TWO = [a + b for a in BASES for b in BASES]
PRINTED = bytes(min(q + 33, 126) for q in range(256))


class Bytes:
    """Decompressed bytes of members in sequence."""

    def __init__(self, members: bgzf.Members):
        self.members, self.held = iter(members), b""

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            self.held += next(self.members)[1]
        out, self.held = self.held[:n], self.held[n:]
        return out


def references(path: str) -> tuple[list[str], int]:
    """Names of the references, and how many decompressed bytes the header has."""
    b = Bytes(bgzf.Members(path))
    try:
        if b.take(4) != b"BAM\1":
            raise ValueError(f"{path}: not a BAM file")
        (n,) = struct.unpack("<i", b.take(4))
        b.take(n)
        (k,) = struct.unpack("<i", b.take(4))
        names, size = [], 12 + n
        for _ in range(k):
            (m,) = struct.unpack("<i", b.take(4))
            names.append(b.take(m)[:-1].decode())
            b.take(4)
            size += 8 + m
    except StopIteration:
        raise ValueError(f"{path}: cut short") from None
    return names, size


def first_record(path: str, header: int) -> int:
    """The virtual offset behind the header."""
    for place, data in bgzf.Members(path):
        if header < len(data):
            return place << 16 | header
        header -= len(data)
    return bgzf.size(path) << 16


def records(members: bgzf.Members, start: int, stop: int) -> Iterator[bytes]:
    """Records that begin at virtual offsets from start, where one begins, up to (not with) stop."""
    rest = b""
    for place, data in members:
        shift = start & 0xFFFF if place == start >> 16 else 0
        begun, held, at = len(rest), rest + data[shift:], 0
        while True:
            if at >= begun and place << 16 | at - begun + shift >= stop:
                return
            n = struct.unpack_from("<i", held, at)[0] if len(held) - at >= 4 else -1
            if n < 0 or len(held) - at < 4 + n:
                break
            yield held[at + 4 : at + 4 + n]
            at += 4 + n
        rest = held[at:]
    if rest:
        raise ValueError(f"{members.path}: cut short within a record")


def decoded(record: bytes, names: list[str]) -> tuple:
    ref, pos, n_name, mapq, _, n_cigar, flags, n_bases, mate, mate_pos, _ = struct.unpack_from("<iiBBHHHiiii", record)
    at = 32 + n_name
    cigar = struct.unpack_from(f"<{n_cigar}I", record, at)
    at += 4 * n_cigar
    packed, quals = record[at : at + (n_bases + 1) // 2], record[at + (n_bases + 1) // 2 : at + (n_bases + 1) // 2 + n_bases]
    return (
        record[32 : at - 4 * n_cigar - 1].decode(), flags, names[ref] if ref >= 0 else "*", pos + 1, mapq, names[mate] if mate >= 0 else None, mate_pos + 1,
        sum(x >> 4 for x in cigar if x & 15 in COVERING), "".join([TWO[x] for x in packed])[:n_bases] or "*",
        quals.translate(PRINTED).decode() if quals and quals.strip(b"\xff") else "*", "".join([f"{x >> 4}{OPERATIONS[x & 15]}" for x in cigar]) or "*",
    )


class AlignmentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = bgzf.listed(options["path"], (".bam",))
        self.split = int(options.get("splitbytes", SPLIT))
        self.pushed = Pushed()
        if options.get("region"):
            r = parse_region(options["region"])
            self.pushed = Pushed({r.chrom}, max(r.start, 1), r.stop)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            self.pushed.take(f)
            yield f

    def partitions(self) -> list[Piece]:
        return [p for path in self.paths for p in self._pieces(path)] or [Piece("", "none")]

    def _pieces(self, path: str) -> list[Piece]:
        names, header = references(path)
        index, end = indexed(path, (".bai", ".csi")) or indexed(path.removesuffix(".bam"), (".bai",)), bgzf.size(path) << 16
        first, p = first_record(path, header), self.pushed
        if index is None:
            return [Piece(path, "exact", first, end)]
        if p.region:
            wanted = [i for i, name in enumerate(names) if name in p.chroms]
            runs = bgzf.joined(sorted(r for i in wanted for r in index.runs(i, max(p.start - 1, 0), p.stop)))
        else:
            runs = [(first, end)]
        return cut(path, runs, index.cuts(), self.split)

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece.kind == "none":
            return
        names, rows = references(piece.path)[0], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)

        for record in records(bgzf.Members(piece.path, piece.start >> 16), piece.start, piece.stop):
            rows.append(decoded(record, names))
            if len(rows) == BATCH:
                yield batch()
                rows = []
        if rows:
            yield batch()


class AlignmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "reads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AlignmentReader:
        return AlignmentReader(self.options)


def alignments(spark: SparkSession, path: str, region: Region | None = None) -> DataFrame:
    """Records of a BAM file, or those of a folder, that overlap a region; columns as readers.alignments."""
    read = registered(spark).read.format("reads")
    if region is None:
        return read.load(path)
    x = read.option("region", f"{region.chrom}:{region.start}-{region.stop}").load(path)
    return x.filter((F.col("chrom") == region.chrom) & (F.col("pos") <= region.stop) & (F.col("pos") + F.col("len") > region.start))
