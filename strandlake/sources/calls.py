"""SRC-03, 04, 08, 13, SNK-03, SNK-12: variant call files as a data source `calls`, with positions pushed down to an index.

    spark.dataSource.register(CallSource)
    spark.read.format("calls").load("panel.vcf.gz").filter("chrom = 'chr20' AND pos BETWEEN 100 AND 200")

Reads plain, gzip and BGZF files (a file or a folder). Filters on chrom and pos name a region; with an index beside the file (.tbi or
.csi) only the members that it names for the region are read, cut into tasks at offsets where the index says that
records begin. BGZF and plain files without an index are cut at members or bytes; a gzip file is one task. Option `cells`
false leaves out the samples' cells (sites only), `splitBytes` is the size of a task. Filters are applied again by
Spark, so an index only ever saves reading. It needs spark.sql.python.filterPushdown.enabled (`registered` sets it).

Written: rows (chrom, pos, value) in order, as one BGZF file and a TBI. Tasks write parts and the part's own index; the commit moves
offsets on by the parts before and joins parts in order of tasks, a buffer at a time. Nothing stands under the name until all is
there, and an abort removes the parts. `write_call_folder` writes a folder of such files, each of a block of samples: a file of all samples
has a cell for every site and sample, called or not, which grows with their product.
"""

from __future__ import annotations

import gzip
import itertools
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..operators.lineage import cut_lineage
from . import bgzf
from .readers import Region

SCHEMA = "chrom string, pos long, id string, ref string, alts array<string>, info map<string,string>, format string, cells array<string>"
TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()), pa.string(), pa.list_(pa.string())]
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
SUFFIXES = (".vcf", ".vcf.gz", ".vcf.bgz")
#: Compressed bytes of a task, and lines of a batch.
SPLIT, BATCH = 16 << 20, 2_000


def registered(spark: SparkSession) -> SparkSession:
    """The session, with the sources of this module and filters pushed to them."""
    from .bam import AlignmentSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (CallSource, JoinedSource, FolderSource, AlignmentSource):
        spark.dataSource.register(source)
    return spark


# filters --------------------------------------------------------------------------------------------------


@dataclass
class Pushed:
    """What filters say of chrom and pos: names (None: any) and 1-based positions, both included."""

    chroms: set[str] | None = None
    start: int = 1
    stop: int = bgzf.END
    position: str = "pos"

    def take(self, f: Filter) -> None:
        if not isinstance(f, (EqualTo, EqualNullSafe, GreaterThan, GreaterThanOrEqual, In, LessThan, LessThanOrEqual)) or len(f.attribute) != 1 or f.value is None:
            return
        name, v = f.attribute[0], f.value
        if name == "chrom" and isinstance(f, (EqualTo, EqualNullSafe, In)):
            some = set(v) if isinstance(f, In) else {v}
            self.chroms = some if self.chroms is None else self.chroms & some
        elif name == self.position:
            if isinstance(f, In):
                some = [x for x in v if x is not None]
                low, high = min(some, default=1), max(some, default=0)
            elif isinstance(f, (EqualTo, EqualNullSafe)):
                low = high = v
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                low, high = v + isinstance(f, GreaterThan), self.stop
            else:
                low, high = self.start, v - isinstance(f, LessThan)
            self.start, self.stop = max(self.start, low), min(self.stop, high)

    @property
    def region(self) -> bool:
        return self.chroms is not None


@dataclass
class Piece(InputPartition):
    """Records of a file that begin in [start, stop): virtual offsets, or bytes (guess: only near them), or all of it."""

    path: str
    kind: str
    start: int = 0
    stop: int = 0

    def __post_init__(self) -> None:
        super().__init__(None)


def indexed(path: str, endings: tuple[str, ...]) -> bgzf.Index | None:
    for e in endings:
        if bgzf.exists(path + e):
            return bgzf.retried(lambda e=e: bgzf.Index.read(path + e))
    return None


def cut(path: str, runs: list[tuple[int, int]], cuts: list[int], split: int) -> list[Piece]:
    """Runs of virtual offsets cut at some of `cuts`, so that each has about `split` bytes; runs that are close make one piece each still."""
    out, at = [], 0
    for start, stop in runs:
        while at < len(cuts) and cuts[at] <= start:
            at += 1
        while at < len(cuts) and cuts[at] < stop:
            if (cuts[at] >> 16) - (start >> 16) >= split:
                out.append(Piece(path, "exact", start, cuts[at]))
                start = cuts[at]
            at += 1
        out.append(Piece(path, "exact", start, stop))
    return out


# reading --------------------------------------------------------------------------------------------------


def header_lines(path: str) -> list[str]:
    """Lines that begin with #."""
    out = []
    for lines in _lines(Piece(path, "plain" if not path.endswith(("gz", "bgz")) else "exact" if bgzf.blocked(path) else "gzip", 0, 1 << 62)):
        for x in lines:
            if x[:1] != b"#":
                return out
            out.append(x.decode())
    return out


def _lines(piece: Piece, members: bgzf.Members | None = None) -> Iterator[list[bytes]]:
    if piece.kind == "exact":
        yield from bgzf.text_lines(members or bgzf.Members(piece.path, piece.start >> 16), piece.start, piece.stop)
    elif piece.kind == "guess":
        start, stop = (bgzf.first_line(piece.path, x) for x in (piece.start, piece.stop))
        if start < stop:
            yield from bgzf.text_lines(bgzf.Members(piece.path, start >> 16), start, stop)
    elif piece.kind == "gzip":
        with bgzf.opened(piece.path) as f, gzip.GzipFile(fileobj=f) as g:
            while lines := g.readlines(1 << 20):
                yield [x.rstrip(b"\n") for x in lines]
    else:
        with bgzf.opened(piece.path) as f:
            f.seek(piece.start)
            place, rest, begun = piece.start, b"", piece.start == 0
            while data := bgzf.retried(lambda: f.read(bgzf.PIECE)):
                lines = (rest + data).split(b"\n")
                place -= len(rest)
                rest = lines.pop()
                own = []
                for x in lines:
                    if begun and place > piece.stop > 0:  # a line that begins at stop itself is still ours: the next piece leaves its first out
                        break
                    if begun:
                        own.append(x)
                    begun = True
                    place += len(x) + 1
                yield own
                if place > piece.stop > 0:
                    return
                place += len(rest)
            if rest and begun and not (place - len(rest) > piece.stop > 0):
                yield [rest]


def parsed(lines: list[bytes], cells: bool) -> pa.RecordBatch | None:
    """Lines of eight fields or more with a number as position; as readers.variants has them."""
    rows = []
    for line in lines:
        if line[:1] == b"#" or not line:
            continue
        f = line.decode("utf-8", "replace").rstrip("\r").split("\t")
        if len(f) < 8 or not f[1].isdigit():
            continue
        info: dict[str, str | None] = {}
        for pair in f[7].split(";"):
            if pair not in ("", "."):
                k, eq, v = pair.partition("=")
                info.setdefault(k, v if eq else None)
        rows.append((f[0], int(f[1]), f[2], f[3], f[4].split(","), list(info.items()), f[8] if len(f) > 8 else None, f[9:] if cells else []))
    if not rows:
        return None
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)


class CallReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = bgzf.listed(options["path"], SUFFIXES)
        self.cells = str(options.get("cells", "true")).lower() != "false"
        self.files = str(options.get("files", "false")).lower() == "true"
        self.split = int(options.get("splitbytes", SPLIT))
        self.pushed = Pushed()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            self.pushed.take(f)
            yield f

    def partitions(self) -> list[Piece]:
        return [p for path in self.paths for p in self._pieces(path)] or [Piece("", "none")]

    def _pieces(self, path: str) -> list[Piece]:
        n = bgzf.size(path)
        bytes_ = range(0, n, self.split)
        if not path.endswith(("gz", "bgz")):
            return [Piece(path, "plain", a, min(a + self.split, n)) for a in bytes_]
        if not bgzf.blocked(path):
            return [Piece(path, "gzip")]
        index = indexed(path, (".tbi", ".csi"))
        if index is None or not index.names:
            return [Piece(path, "guess", a, min(a + self.split, n)) for a in bytes_]
        p = self.pushed
        if p.region or p.start > 1 or p.stop < bgzf.END:
            wanted = [i for i, name in enumerate(index.names) if p.chroms is None or name in p.chroms]
            runs = bgzf.joined(sorted(r for i in wanted for r in index.runs(i, max(p.start - 1, 0), p.stop)))
        else:
            runs = [(0, n << 16)]
        return cut(path, runs, index.cuts(), self.split)

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        if piece.kind == "none":
            return
        held: list[bytes] = []
        for lines in itertools.chain(_lines(piece), [None]):
            held += lines or []
            least = BATCH if lines is not None else 1
            while len(held) >= least:
                if (batch := parsed(held[:BATCH], self.cells)) is not None:
                    file = [pa.array([piece.path] * batch.num_rows, pa.string())] if self.files else []
                    yield pa.RecordBatch.from_arrays([*batch.columns, *file], names=[*NAMES, "file"][: len(NAMES) + len(file)])
                del held[:BATCH]


class CallSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "calls"

    def schema(self) -> str:
        return SCHEMA + ", file string" if str(self.options.get("files", "false")).lower() == "true" else SCHEMA

    def reader(self, schema) -> CallReader:
        return CallReader(self.options)

    def writer(self, schema, overwrite: bool) -> CallWriter:
        return CallWriter(self.options, overwrite)


def calls(spark: SparkSession, path: str, region: Region | None = None, cells: bool = True, split: int = SPLIT, files: bool = False) -> DataFrame:
    """SRC-03, 04, 08, 13: a call file, or those of a folder, in a region, by tasks of about `split` bytes; columns as readers.variants, and the line's file if asked for."""
    x = registered(spark).read.format("calls").options(cells=str(cells).lower(), files=str(files).lower()).option("splitBytes", split).load(path)
    return x if region is None else x.filter((F.col("chrom") == region.chrom) & F.col("pos").between(region.start, region.stop))


def sample_names(path: str) -> list[str]:
    """Samples of the first file's header."""
    for line in header_lines(bgzf.listed(path, SUFFIXES)[0]):
        if line.startswith("#CHROM"):
            return line.rstrip("\r").split("\t")[9:]
    return []


def sample_table(spark: SparkSession, path: str) -> DataFrame:
    """(file, i, sample): samples of the headers of a folder's files, which tasks read."""
    def names(batches):
        for batch in batches:
            for file in batch["file"].to_pylist():
                found = sample_names(file)
                columns = [pa.array([file] * len(found), pa.string()), pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["file", "i", "sample"])

    files = [(f,) for f in bgzf.listed(path, SUFFIXES)]
    return spark.createDataFrame(files, "file string").mapInArrow(names, "file string, i int, sample string")


# writing --------------------------------------------------------------------------------------------------


@dataclass
class Part(WriterCommitMessage):
    """A task's part: its place among tasks, file, bytes, rows and, for calls, its index."""

    order: int = 0
    path: str = ""
    bytes: int = 0
    rows: int = 0
    index: bgzf.Index | None = field(default=None)


class JoinedWriter(DataSourceWriter):
    """One file of parts that tasks write: column `block` (binary), in order of partitions, behind a header."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        if bgzf.exists(self.path) and not overwrite:
            raise ValueError(f"{self.path} exists")
        self.header = bytes.fromhex(options.get("header", ""))
        self.counted = int(options.get("countat", -1))
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"
        system, at = bgzf.store(self.folder)
        system.create_dir(at)

    def _part(self) -> tuple[Part, pa.NativeFile]:
        order = TaskContext.get().partitionId()
        path = f"{self.folder}/{order:07d}-{uuid.uuid4().hex}"  # every attempt its own
        system, at = bgzf.store(path)
        return Part(order, path), system.open_output_stream(at)

    def write(self, iterator) -> Part:
        part, out = self._part()
        with out:
            for row in iterator:
                out.write(row["block"])
                part.rows += 1
                part.bytes += len(row["block"])
        return part

    def head(self, parts: list[Part]) -> bytes:
        """The header; the number of rows is put in where the option says."""
        if self.counted < 0:
            return self.header
        return self.header[: self.counted] + struct.pack("<I", sum(p.rows for p in parts)) + self.header[self.counted + 4 :]

    def tail(self) -> bytes:
        return b""

    def commit(self, messages: list) -> None:
        parts = sorted((m for m in messages if m is not None), key=lambda p: p.order)
        system, at = bgzf.store(self.path)
        temporary = f"{at}.joining-{uuid.uuid4().hex}"
        try:
            with system.open_output_stream(temporary) as out:
                out.write(self.head(parts))
                for p in parts:
                    with bgzf.opened(p.path) as f:
                        while data := f.read(bgzf.PIECE):
                            out.write(data)
                out.write(self.tail())
            self.beside(parts)
            system.move(temporary, at)
        finally:
            if system.get_file_info(temporary).type == fs.FileType.File:
                system.delete_file(temporary)
            self.abort(messages)

    def beside(self, parts: list[Part]) -> None:
        """What is written beside the file."""

    def abort(self, messages: list) -> None:
        system, at = bgzf.store(self.folder)
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)


class Lines:
    """Lines of calls as BGZF members of a stream that has so many bytes already, and their index."""

    def __init__(self, out: pa.NativeFile, before: int = 0):
        self.out, self.bytes, self.rows, self.index = out, before, 0, bgzf.Index()
        self.held, self.last = bytearray(), None

    def flush(self, least: int) -> None:
        while len(self.held) >= least and self.held:
            data = bgzf.member(bytes(self.held[: bgzf.MEMBER]))
            self.out.write(data)
            self.bytes += len(data)
            del self.held[: bgzf.MEMBER]

    def add(self, chrom: str, pos: int, value: str) -> None:
        if self.last and self.last[0] == chrom and self.last[1] > pos:
            raise ValueError(f"positions are out of order at {chrom}:{pos}")
        self.last = (chrom, pos)
        at = self.bytes << 16 | len(self.held)
        self.held += value.encode() + b"\n"
        self.flush(bgzf.MEMBER)
        ref = value.split("\t", 4)[3]
        self.index.add(chrom, pos - 1, pos - 1 + max(1, len(ref)), at, self.bytes << 16 | len(self.held))
        self.rows += 1


class CallWriter(JoinedWriter):
    """Rows (chrom, pos, value) as BGZF members, with their index."""

    def head(self, parts: list[Part]) -> bytes:
        return b"".join(bgzf.member(self.header[i : i + bgzf.MEMBER]) for i in range(0, len(self.header), bgzf.MEMBER))

    def tail(self) -> bytes:
        return bgzf.EOF

    def write(self, iterator) -> Part:
        part, out = self._part()
        with out:
            lines = Lines(out)
            for row in iterator:
                lines.add(row["chrom"], row["pos"], row["value"])
            lines.flush(1)
        part.bytes, part.rows, part.index = lines.bytes, lines.rows, lines.index
        return part

    def beside(self, parts: list[Part]) -> None:
        index, at = bgzf.Index(), len(self.head(parts))
        for p in parts:
            index.append(p.index, at)
            at += p.bytes
        system, path = bgzf.store(self.path + ".tbi")
        with system.open_output_stream(path) as out:
            out.write(index.tbi())


class JoinedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "joined"

    def schema(self) -> str:
        return "block binary"

    def writer(self, schema, overwrite: bool) -> JoinedWriter:
        return JoinedWriter(self.options, overwrite)


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has completed."""

    paths: list[str] = field(default_factory=list)


class FolderWriter(DataSourceWriter):
    """Rows (block, chrom, pos, value) in order as a folder of call files, each with its index: of a block of samples, the rows of one task.

    Tasks complete files, the commit gives the folder its name; nothing passes through it but names of files.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        system, at = bgzf.store(self.path)
        if system.get_file_info(at).type != fs.FileType.NotFound:
            raise ValueError(f"{self.path} exists")
        self.lines, self.names, self.width = options["header"].split("\n"), options["samples"].split("\t"), int(options["width"])
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"
        system, at = bgzf.store(self.folder)
        system.create_dir(at)

    def head(self, block: int) -> bytes:
        names = self.names[block * self.width : (block + 1) * self.width]
        data = "".join(x + "\n" for x in [*self.lines[:-1], "\t".join([self.lines[-1], *names])]).encode()
        return b"".join(bgzf.member(data[i : i + bgzf.MEMBER]) for i in range(0, len(data), bgzf.MEMBER))

    def write(self, iterator) -> Written:
        done = Written()
        order = TaskContext.get().partitionId()
        for block, rows in itertools.groupby(iterator, key=lambda r: r["block"]):
            path = f"{self.folder}/{block:07d}-{order:07d}-{uuid.uuid4().hex}.vcf.gz"  # every attempt its own
            system, at = bgzf.store(path)
            head = self.head(block)
            with system.open_output_stream(at, compression=None) as out:
                out.write(head)
                lines = Lines(out, len(head))
                for row in rows:
                    lines.add(row["chrom"], row["pos"], row["value"])
                lines.flush(1)
                out.write(bgzf.EOF)
            with system.open_output_stream(at + ".tbi") as out:
                out.write(lines.index.tbi())
            done.paths.append(path)
        return done

    def commit(self, messages: list) -> None:
        own = {p.rsplit("/", 1)[1] for m in messages if m is not None for p in m.paths}
        system, at = bgzf.store(self.folder)
        for f in system.get_file_info(fs.FileSelector(at)):  # of attempts that don't count
            if f.base_name.removesuffix(".tbi") not in own:
                system.delete_file(f.path)
        system.move(at, bgzf.store(self.path)[1])

    def abort(self, messages: list) -> None:
        system, at = bgzf.store(self.folder)
        if system.get_file_info(at).type == fs.FileType.Directory:
            system.delete_dir(at)


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "callfolder"

    def schema(self) -> str:
        return "block int, chrom string, pos long, value string"

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(self.options, overwrite)


def write_call_folder(lines: DataFrame, path: str, header: list[str], sample_names: list[str], width: int) -> None:
    """SNK-03, SNK-12: rows (block, chrom, pos, value), in order over the partitions, as a folder of indexed BGZF files, each of a block of width samples.

    header: lines without names of samples, the last one's columns.
    """
    registered(lines.sparkSession)
    options = {"header": "\n".join(header), "samples": "\t".join(sample_names), "width": str(width)}
    lines.select("block", "chrom", "pos", "value").write.format("callfolder").mode("append").options(**options).save(path)


def write_call_file(lines: DataFrame, path: str, header: list[str]) -> None:
    """SNK-03, SNK-12: rows (chrom, pos, value) as one sorted, indexed BGZF file with these header lines. Chromosomes stand in order of their names."""
    registered(lines.sparkSession)
    lines = cut_lineage(lines.select("chrom", "pos", "value"))  # bounds of ranges are sampled first: lines aren't made twice
    ordered = lines.select("chrom", "pos", "value").repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos")
    ordered.write.format("calls").mode("overwrite").option("header", "".join(x + "\n" for x in header).encode().hex()).save(path)
