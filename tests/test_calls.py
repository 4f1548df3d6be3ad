"""Call files and alignments as data sources: blocks, indexes, regions, splits, commits."""

import gzip
import random
import re
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import pileup
from strandlake.sources import bam, bgzf, calls, readers, sinks


def call_lines(n=3_000):
    rng = random.Random(3)
    rows = []
    for chrom in ("chr1", "chr2", "chr3"):
        pos = 1
        for i in range(n if chrom != "chr2" else 40):
            pos += rng.choice([0, 1, 7, 300, 40_000 if i % 50 == 0 else 2])
            ref = rng.choice(["A", "C", "ACGT" * rng.choice([1, 1, 2_000])]) if i % 97 == 0 else "A"
            cells = "\t".join(rng.choice(["0|1:3", "0|0:.", "./.:1"]) for _ in range(3))
            rows.append((chrom, pos, f"{chrom}\t{pos}\tr{i}\t{ref}\tC{',G' if i % 5 == 0 else ''}\t.\tPASS\tAC={i};AN=6;DB\tGT:X\t{cells}"))
    return rows


HEADER = ["##fileformat=VCFv4.2", "##contig=<ID=chr1,length=100>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc"]


@pytest.fixture(scope="module")
def rows():
    return call_lines()


@pytest.fixture(scope="module")
def file(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("calls") / "x.vcf.gz")
    df = spark.createDataFrame(rows, "chrom string, pos long, value string").repartition(5)
    calls.write_call_file(df, path, HEADER)
    return path


def keyed(found):
    return sorted((r["chrom"], r["pos"], r["id"]) for r in found)


def expected(rows, keep):
    return sorted((c, p, v.split("\t")[2]) for c, p, v in rows if keep(c, p))


def pieces(path, *filters, split=1 << 14):
    reader = calls.CallReader({"path": path, "splitbytes": str(split)})
    assert list(reader.pushFilters(list(filters))) == list(filters)
    return reader, reader.partitions()


def test_written_file_is_ordinary_gzip(file, rows):
    text = gzip.open(file).read().decode().splitlines()
    assert text[:3] == HEADER and sorted(text[3:]) == sorted(v for _, _, v in rows)
    assert [x.split("\t")[0] for x in text[3:]] == sorted(x.split("\t")[0] for x in text[3:]) and Path(file).read_bytes().endswith(bgzf.EOF)
    assert calls.sample_names(file) == ["a", "b", "c"] and not list(Path(file).parent.glob("*parts*")) and not list(Path(file).parent.glob("*joining*"))


REGIONS = [("chr1", 1, 5_000), ("chr1", 60_000, 61_000), ("chr2", 1, 1 << 30), ("chr3", 123_456, 2_000_000), ("chr1", 900_000_000, 900_000_001), ("chr9", 1, 10), ("chr3", 17, 17)]


@pytest.mark.parametrize("form", ["indexed", "unindexed", "plain", "gzip"])
def test_regions_equal_the_filtered_whole(spark, file, rows, tmp_path, form):
    path = file
    if form != "indexed":
        path = str(tmp_path / ("y.vcf" if form == "plain" else "y.vcf.gz"))
        data = Path(file).read_bytes()
        Path(path).write_bytes(data if form == "unindexed" else gzip.decompress(data) if form == "plain" else gzip.compress(gzip.decompress(data)))
    for chrom, start, stop in REGIONS if form == "indexed" else REGIONS[1:4]:
        df = calls.registered(spark).read.format("calls").option("splitBytes", 20_000).load(path).filter((F.col("chrom") == chrom) & F.col("pos").between(start, stop))
        assert keyed(df.collect()) == expected(rows, lambda c, p: c == chrom and start <= p <= stop)  # noqa: B023


@pytest.mark.parametrize("split", [1, 700, 5_000, 40_000, 1 << 30])
@pytest.mark.parametrize("form", ["indexed", "unindexed", "plain"])
def test_splits_hold_every_line_once(file, rows, tmp_path, split, form):
    path = file
    if form != "indexed":
        path = str(tmp_path / ("y.vcf" if form == "plain" else "y.vcf.gz"))
        Path(path).write_bytes(gzip.decompress(Path(file).read_bytes()) if form == "plain" else Path(file).read_bytes())
    if split < 700 and form == "plain":
        split = 300
    reader, parts = pieces(path, split=split)
    found = [(c, p, i) for part in parts for b in reader.read(part) for c, p, i in zip(*(b.column(k).to_pylist() for k in (0, 1, 2)), strict=True)]
    assert sorted(found) == expected(rows, lambda c, p: True)
    assert len(parts) > 1 or split == 1 << 30


def test_only_members_of_the_region_are_read(file, rows, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThanOrEqual

    made = []
    real = bgzf.Members
    monkeypatch.setattr(bgzf, "Members", lambda *a: made.append(real(*a)) or made[-1])

    def members(*filters):
        reader, parts = pieces(file, *filters, split=1 << 30)
        made.clear()
        n = sum(b.num_rows for p in parts for b in reader.read(p))
        return n, sum(m.count for m in made)

    whole, every = members()
    assert whole == len(rows) and every >= 10
    few, some = members(EqualTo(("chrom",), "chr3"), GreaterThanOrEqual(("pos",), 100_000), LessThanOrEqual(("pos",), 104_000))
    assert 0 < few < whole / 2 and some <= 3 < every
    assert members(EqualTo(("chrom",), "chr2"))[1] <= 3
    assert members(EqualTo(("chrom",), "elsewhere")) == (0, 0)


def test_filters_reach_the_source(spark, file):
    df = calls.calls(spark, file, readers.Region("chr1", 10, 500))
    text = df._jdf.queryExecution().toString()
    assert "EqualTo" in text.replace("'", "") or "PushedFilters" in text or "BatchScan" in text
    whole = calls.calls(spark, file, cells=False)
    assert whole.select(F.max(F.size("cells"))).first()[0] == 0


def test_columns_are_those_of_the_text_reader(spark, file, tmp_path):
    plain = tmp_path / "z.vcf"
    plain.write_bytes(gzip.decompress(Path(file).read_bytes()))
    a, b = calls.calls(spark, file), readers.variants(spark, str(plain))
    assert a.columns == b.columns
    keys = ["chrom", "pos", "id"]
    assert a.orderBy(*keys).collect() == b.orderBy(*keys).collect()
    one = readers.cells(a.withColumn("alt", F.concat_ws(",", "alts")), calls.sample_names(file))
    assert one.count() == 3 * a.count()


def test_wide_index_and_csi(tmp_path, rows, file):
    """The same index as CSI: least offsets by bin instead of windows."""
    index = bgzf.Index.read(file + ".tbi")
    out = [struct.pack("<4s3i", b"CSI\1", 14, 5, 28 + sum(len(n) + 1 for n in index.names)), struct.pack("<7i", 2, 1, 2, 0, 35, 0, sum(len(n) + 1 for n in index.names)), b"".join(n.encode() + b"\0" for n in index.names), struct.pack("<i", len(index.names))]
    for bins in index.bins:
        out.append(struct.pack("<i", len(bins)))
        for number, runs in bins.items():
            out.append(struct.pack("<IQi", number, runs[0][0] if number >= 4681 else 0, len(runs)) + b"".join(struct.pack("<QQ", *r) for r in runs))
    raw = b"".join(out)
    path = tmp_path / "x.vcf.gz"
    path.write_bytes(Path(file).read_bytes())
    Path(f"{path}.csi").write_bytes(b"".join(bgzf.member(raw[i : i + 60_000]) for i in range(0, len(raw), 60_000)) + bgzf.EOF)
    from pyspark.sql.datasource import EqualTo, In, LessThan

    reader, parts = pieces(str(path), EqualTo(("chrom",), "chr1"), LessThan(("pos",), 30_000), In(("pos",), (5_000, 29_000)), split=1 << 30)
    got = {(c, p, i) for part in parts for b in reader.read(part) for c, p, i in zip(*(b.column(k).to_pylist() for k in (0, 1, 2)), strict=True)}
    assert got >= set(expected(rows, lambda c, p: c == "chr1" and 5_000 <= p <= 29_000)) and len(got) < len(rows) / 2


def test_bins():
    rng = random.Random(1)
    for _ in range(300):
        a = rng.randrange(1 << 29)
        b = min(a + rng.choice([1, 100, 20_000, 1 << 20]), 1 << 29)
        assert bgzf.bin_of(a, b) in bgzf.bins_of(a, b) and bgzf.bin_of(a, a + 1) >= 4681


def test_failed_and_refused_writes_leave_nothing(spark, rows, tmp_path):
    path = tmp_path / "f.vcf.gz"
    df = spark.createDataFrame(rows, "chrom string, pos long, value string")
    broken = df.withColumn("value", F.when((F.col("chrom") == "chr3") & (F.col("pos") > 50_000), F.raise_error(F.lit("no line"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no line"):
        calls.write_call_file(broken, str(path), HEADER)
    assert list(tmp_path.iterdir()) == []
    calls.write_call_file(df.limit(0), str(path), HEADER)
    assert calls.calls(spark, str(path)).count() == 0
    calls.write_call_file(df.filter("chrom = 'chr2'"), str(path), HEADER)  # again
    assert calls.calls(spark, str(path)).count() == 40 and sorted(x.name for x in tmp_path.iterdir()) == ["f.vcf.gz", "f.vcf.gz.tbi"]
    with pytest.raises(Exception, match="out of order"):
        df.filter("chrom = 'chr2'").orderBy(F.desc("pos")).coalesce(1).write.format("calls").mode("overwrite").option("header", "").save(str(path))
    assert calls.calls(spark, str(path)).count() == 40  # what was there stays


def test_cut_short(spark, file, tmp_path):
    path = tmp_path / "cut.vcf.gz"
    path.write_bytes(Path(file).read_bytes()[:-5_000])
    with pytest.raises(Exception, match="cut short"):
        calls.calls(spark, str(path)).count()


def test_errors_are_retried(monkeypatch):
    monkeypatch.setattr(bgzf.time, "sleep", lambda s: waits.append(s))
    waits, tries = [], []

    def action():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("connection reset")
        return "read"

    assert bgzf.retried(action) == "read" and waits == [1.0, 2.0]
    with pytest.raises(FileNotFoundError):
        bgzf.retried(lambda: Path("/nowhere/at/all").read_bytes())
    with pytest.raises(OSError):
        bgzf.retried(lambda: tries.clear() or (_ for _ in ()).throw(OSError()), attempts=2)


def test_folder_of_files(spark, file, rows, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.vcf.gz").write_bytes(Path(file).read_bytes())
    (tmp_path / "other.txt").write_text("no calls")
    assert calls.calls(spark, str(tmp_path), readers.Region("chr2", 1, 1 << 30)).count() == 3 * 40


# alignments -----------------------------------------------------------------------------------------------


def sam_rows(n=4_000):
    rng = random.Random(8)
    out, pos = [], 1
    for i in range(n):
        pos += rng.randrange(0, 60) if i != 2_500 else 200_000
        m = rng.randrange(20, 60)
        shape = i % 7
        cigar = ["*", f"{m}M", f"5S{m}M", f"10M2I{m}M", f"10M3D{m}M", f"10M40N{m}M3S", f"4H{m}=1X"][shape] if i % 13 else f"{m}M"
        length = {"*": m}.get(cigar, sum(int(k) for k, op in zip(*[iter(re.findall(r"\d+|[MIDNSHP=X]", cigar))] * 2, strict=True) if op in "MIS=X"))
        bases = "".join(rng.choices("ACGTN", k=length)) if i % 31 else "*"
        quals = "".join(chr(33 + rng.randrange(60)) for _ in range(length)) if bases != "*" and i % 11 else "*"
        out.append((f"read{i}", rng.choice([0, 16, 99, 1024]), "c1" if i < 3_000 else "c2" if i < 3_990 else "*", pos if i < 3_990 else 0, rng.randrange(61), rng.choice(["=", "*", "c2"]) if i < 3_990 else "*", rng.randrange(1, 10_000), cigar if i < 3_990 else "*", bases, quals))
        if i == 2_999:
            pos = 1
    return out


REFERENCES = ["c1", "c2", "c3"]


def write_bam(path, rows, index=True):
    """A small writer of the format for tests: header, records, members and BAI."""
    codes, ops = {b: i for i, b in enumerate("=ACMGRSVTWYHKDBN")}, {o: i for i, o in enumerate("MIDNSHP=X")}
    text = b"@HD\tVN:1.6\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 3) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1 << 20) for n in REFERENCES)
    out, held, places = [], bytearray(head), []
    done = 0

    def flush(least):
        nonlocal done
        while held and len(held) >= least:
            out.append(bgzf.member(bytes(held[:9_000])))
            done += len(out[-1])
            del held[:9_000]

    flush(9_000)
    for name, flags, chrom, pos, mapq, mate, mate_pos, cigar, bases, quals in rows:
        parts = [] if cigar == "*" else re.findall(r"(\d+)([MIDNSHP=X])", cigar)
        ref = REFERENCES.index(chrom) if chrom != "*" else -1
        mate_ref = ref if mate == "=" else REFERENCES.index(mate) if mate != "*" else -1
        seq = "" if bases == "*" else bases
        packed = bytes((codes[a] << 4) | codes[b] for a, b in zip(seq[::2], seq[1::2] + ("=" if len(seq) % 2 else ""), strict=True))
        q = b"\xff" * len(seq) if quals == "*" else bytes(ord(c) - 33 for c in quals)
        body = struct.pack("<iiBBHHHiiii", ref, pos - 1, len(name) + 1, mapq, 0, len(parts), flags, len(seq), mate_ref, mate_pos - 1, 0) + name.encode() + b"\0" + b"".join(struct.pack("<I", int(n) << 4 | ops[o]) for n, o in parts) + packed + q + b"XXZtag\0"
        at = done << 16 | len(held)
        held += struct.pack("<i", len(body)) + body
        flush(9_000)
        span = sum(int(n) for n, o in parts if o in "MDN=X")
        places.append((ref, pos - 1, pos - 1 + max(1, span), at, done << 16 | len(held)))
    flush(1)
    Path(path).write_bytes(b"".join(out) + bgzf.EOF)
    if index:
        made = bgzf.Index()
        for ref, a, b, at, end in places:
            if ref >= 0:
                made.add(REFERENCES[ref], a, b, at, end)
        data = b"BAI\1" + struct.pack("<i", 3)
        for k in range(3):
            bins, linear = (made.bins[k], made.linear[k]) if k < len(made.names) else ({}, [])
            data += struct.pack("<i", len(bins) + 1) + b"".join(struct.pack("<Ii", n, len(r)) + b"".join(struct.pack("<QQ", *x) for x in r) for n, r in bins.items())
            data += struct.pack("<Ii4Q", 37450, 2, 0, 0, 0, 0) + struct.pack(f"<i{len(linear)}Q", len(linear), *linear)  # a bin of totals
        Path(path + ".bai").write_bytes(data)


@pytest.fixture(scope="module")
def both(tmp_path_factory):
    folder, rows = tmp_path_factory.mktemp("reads"), sam_rows()
    (folder / "x.sam").write_text("@HD\tVN:1.6\n" + "".join("\t".join(map(str, (n, f, c, p, q, g, m, mp, 0, b, ql))) + "\n" for n, f, c, p, q, m, mp, g, b, ql in rows))
    write_bam(str(folder / "x.bam"), rows)
    return str(folder / "x.sam"), str(folder / "x.bam"), rows


@pytest.mark.parametrize("region", [None, readers.Region("c1", 1, 5_000), readers.Region("c1", 150_000, 260_000), readers.Region("c2", 3_000, 3_001), readers.Region("c3", 1, 9)])
@pytest.mark.parametrize("index", [True, False])
def test_binary_and_text_alignments_agree(spark, both, tmp_path, region, index):
    sam, path, rows = both
    if not index:
        write_bam(path := str(tmp_path / "n.bam"), rows, index=False)
    a, b = readers.alignments(spark, sam, region), bam.alignments(spark, path, region)
    assert a.columns == b.columns and a.orderBy("read_id").collect() == b.orderBy("read_id").collect()
    assert region is not None or b.count() == len(rows)


def test_likelihoods_agree(spark, both):
    sam, path, _ = both
    sites = spark.createDataFrame([(i, i * 37 + 5, "A", "C") for i in range(3_000)], "site int, pos long, ref string, alt string")
    one, two = (
        sorted(map(tuple, pileup.likelihoods(pileup.usable_bases(pileup.pile_up(x.filter("chrom = 'c1'").withColumn("sample", F.lit(1)), sites, 128))).select("sample", "site", "depth", "pl", "flat").collect()))
        for x in (readers.alignments(spark, sam), bam.alignments(spark, path))
    )
    assert one == two and len(one) > 1_000


def test_alignments_are_split_and_pruned(both):
    _, path, rows = both
    whole = bam.AlignmentReader({"path": path, "splitbytes": "8000"})
    parts = whole.partitions()
    assert len(parts) > 5 and sum(b.num_rows for p in parts for b in whole.read(p)) == len(rows)
    some = bam.AlignmentReader({"path": path, "region": "c2:1-500"})
    assert 0 < sum(b.num_rows for p in some.partitions() for b in some.read(p)) < len(rows) / 5
    assert bam.AlignmentReader({"path": path, "region": "c9:1-500"}).partitions()[0].kind == "none"


def test_alignments_cut_short(spark, both, tmp_path):
    _, path, _ = both
    data, at, places = Path(path).read_bytes(), 0, []
    while at < len(data):
        places.append(at)
        at += bgzf.member_size(data[at : at + 64])
    cut = tmp_path / "cut.bam"
    cut.write_bytes(data[: places[-3]])  # at the end of a member, within a record
    with pytest.raises(Exception, match="cut short"):
        bam.alignments(spark, str(cut)).count()


def test_members():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 255, 0xFF00, dtype=np.uint8).tobytes()
    m = bgzf.member(data)
    assert bgzf.member_size(m) == len(m) and gzip.decompress(m) == data and zlib.crc32(data) == struct.unpack("<I", m[-8:-4])[0]
    assert bgzf.member_size(gzip.compress(b"x")) == 0


def test_folder_of_blocks_of_samples(spark, tmp_path):
    """Lines grow with the calls, not with sites times samples; what is read back by regions is what was called."""
    names = [f"s{i}" for i in range(41)]
    sites = spark.createDataFrame([(k, k * 100, ".", "A", "C", 0.5, 0.5, 0.5) for k in range(1, 201)], "site int, pos int, id string, ref string, alt string, raf double, af double, info double")
    rows = [(k, names[(k * 7 + j) % 41], (k + j) % 3, (k + j) % 3 / 1.0, [0.25, 0.5, 0.25], None, None) for k in range(1, 201) for j in (0, 1)]
    called = spark.createDataFrame(rows, "site int, sample string, gt int, ds double, gp array<double>, h0 int, h1 int")
    lines = sinks.call_groups(sites, called, names, "chr1", width=4)
    assert lines.count() <= 400 and lines.selectExpr("max(size(split(value, '\t')))").first()[0] == 9 + 4  # whatever the number of samples
    path = str(tmp_path / "calls")
    calls.write_call_folder(lines, path, sinks.call_header([], "chr1"), names, 4)
    assert sorted(x.name for x in tmp_path.iterdir()) == ["calls"]
    table = calls.sample_table(spark, path)
    assert {r["sample"] for r in table.collect()} == set(names)
    for start, stop in ((1, 1 << 30), (5_000, 9_950)):
        found = calls.calls(spark, path, readers.Region("chr1", start, stop), files=True).withColumn("alt", F.get("alts", F.lit(0)))
        cells = readers.cells(found, table, missing=False)
        got = sorted((r["pos"] // 100, r["sample"], sum(r["gt"]), float(r["fields"]["DS"])) for r in cells.collect())
        assert got == sorted((k, s, g, ds) for k, s, g, ds, *_ in rows if start <= k * 100 <= stop)
    with pytest.raises(Exception, match="exists"):
        calls.write_call_folder(lines, path, sinks.call_header([], "chr1"), names, 4)
