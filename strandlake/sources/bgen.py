"""SNK-04: genotype probabilities in the BGEN format, version 1.2, layout 2 (unphased, two alleles).

Executors encode a block of bytes per site and write them, in order of position, as parts that the commit joins behind the header.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calls import registered

# Compressions of the format by name; flags of the layout and of sample identifiers.
COMPRESSIONS = {"none": 0, "zlib": 1, "zstd": 2}
LAYOUT, IDENTIFIERS = 2 << 2, 1 << 31


def _text(value: str, size: str) -> bytes:
    raw = value.encode()
    return struct.pack(f"<{size}", len(raw)) + raw


def quantised(p: np.ndarray, bits: int) -> np.ndarray:
    """Rows of probabilities as whole numbers that sum to 2**bits - 1: rounded down, what is missing goes to the largest remainders."""
    scaled = p / p.sum(axis=1, keepdims=True) * ((1 << bits) - 1)
    low = np.floor(scaled)
    rest = scaled - low
    missing = np.rint(rest.sum(axis=1)).astype(np.int64)
    rank = np.argsort(np.argsort(-rest, axis=1, kind="stable"), axis=1, kind="stable")
    return (low + (rank < missing[:, None])).astype(np.int64)


def _bits(values: np.ndarray, bits: int) -> bytes:
    """Numbers one behind another, low bits first."""
    if bits in (8, 16, 32):
        return values.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def _packed(data: bytes, compression: str) -> bytes:
    if compression == "zlib":
        return zlib.compress(data)
    if compression == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    return data


def variant(names: tuple[str, str], chrom: str, pos: int, alleles: tuple[str, str], gp: np.ndarray, ploidy: np.ndarray, bits: int, compression: str) -> bytes:
    """A site's block. gp: (samples, 3), rows of nulls (nan) are missing; haploid samples use the first two."""
    missing = np.isnan(gp[:, :2]).any(axis=1)
    values = np.zeros((len(gp), 2), dtype=np.int64)
    two = (ploidy == 2) & ~missing
    one = (ploidy == 1) & ~missing
    if two.any():
        values[two] = quantised(gp[two], bits)[:, :2]
    if one.any():
        values[one, 0] = quantised(gp[one, :2], bits)[:, 0]
    kept = np.arange(2) < ploidy[:, None]  # one number fewer than there are genotypes
    data = struct.pack("<IHBB", len(gp), 2, int(ploidy.min(initial=2)), int(ploidy.max(initial=2))) + (ploidy | np.where(missing, 128, 0)).astype(np.uint8).tobytes() + struct.pack("<BB", 0, bits) + _bits(values[kept], bits)
    head = _text(names[0], "H") + _text(names[1], "H") + _text(chrom, "H") + struct.pack("<IH", pos, 2) + b"".join(_text(a, "I") for a in alleles)
    if compression == "none":
        return head + struct.pack("<I", len(data)) + data
    body = _packed(data, compression)
    return head + struct.pack("<II", len(body) + 4, len(data)) + body


def header(variants: int, names: list[str], compression: str) -> bytes:
    ids = b"".join(_text(n, "H") for n in names)
    listed = struct.pack("<II", 8 + len(ids), len(names)) + ids
    block = struct.pack("<III4sI", 20, variants, len(names), b"bgen", COMPRESSIONS[compression] | LAYOUT | IDENTIFIERS)
    return struct.pack("<I", len(block) + len(listed)) + block + listed


def blocks(sites: DataFrame, called: DataFrame, names: list[str], chrom: str, bits: int = 8, compression: str = "zlib") -> DataFrame:
    """(pos, site, block). sites: site, pos, id, ref, alt, in_core (only those are written); called: site, sample, gp (array), ploidy if not all are diploid."""
    place = {n: i for i, n in enumerate(names)}
    ploidy = F.col("ploidy") if "ploidy" in called.columns else F.lit(2)
    core = sites.filter("in_core") if "in_core" in sites.columns else sites
    gp = [F.get("gp", F.lit(k)).cast("double").alias(f"gp{k}") for k in range(3)]
    cells = called.select("site", F.col("sample").cast("string").alias("sample"), *gp, ploidy.cast("int").alias("ploidy"))
    rows = core.select("site", "pos", "id", "ref", "alt").join(cells, "site", "left")

    def work(group: pa.Table) -> pa.Table:
        first = group.slice(0, 1).to_pylist()[0]
        p, own = np.full((len(names), 3), np.nan), np.full(len(names), 2, dtype=np.int64)
        at = np.array([place.get(s, -1) for s in group.column("sample").to_pylist()])
        known = at >= 0
        if known.any():
            p[at[known]] = np.stack([group.column(f"gp{k}").to_numpy(zero_copy_only=False).astype(np.float64)[known] for k in range(3)], axis=1)
            own[at[known]] = group.column("ploidy").to_numpy(zero_copy_only=False)[known]
        long = f"{chrom}:{first['pos']}_{first['ref']}_{first['alt']}"
        block = variant((long, first["id"] or "."), chrom, first["pos"], (first["ref"], first["alt"]), p, own, bits, compression)
        return pa.table([pa.array([first["pos"]], pa.int64()), pa.array([first["site"]], pa.int64()), pa.array([block], pa.binary())], names=["pos", "site", "block"])

    if not 1 <= bits <= 32 or compression not in COMPRESSIONS:
        raise ValueError("bits must be within 1 and 32, compression one of none, zlib, zstd")
    typed = rows.withColumns({"pos": F.col("pos").cast("long"), "site": F.col("site").cast("long")})
    return typed.groupBy("site").applyInArrow(work, "pos long, site long, block binary")


def write(encoded: DataFrame, path: str, names: list[str], compression: str = "zlib") -> None:
    """The blocks behind a header as one file: tasks write ranges of positions, the commit counts them and joins the parts (calls.JoinedWriter)."""
    registered(encoded.sparkSession)
    ordered = encoded.repartitionByRange("pos", "site").sortWithinPartitions("pos", "site").select("block")
    # the number of sites stands behind the offset and the header's own size
    ordered.write.format("joined").mode("overwrite").option("header", header(0, names, compression).hex()).option("countAt", "8").save(path)


def read(data: bytes) -> tuple[list[str], Iterator[dict]]:
    """Sample names, and the sites of a file of this layout: names, chrom, pos, alleles, ploidy, gp (nan where missing)."""
    offset, size, variants, n, magic, flags = struct.unpack_from("<IIII4sI", data)
    if magic != b"bgen" or flags >> 2 & 15 != 2:
        raise ValueError("not a file of layout 2")
    at, samples = 4 + size + 8, []
    for _ in range(n):
        k = struct.unpack_from("<H", data, at)[0]
        samples.append(data[at + 2 : at + 2 + k].decode())
        at += 2 + k

    def sites() -> Iterator[dict]:
        at = 4 + offset
        for _ in range(variants):
            words = []
            for _ in range(3):
                k = struct.unpack_from("<H", data, at)[0]
                words.append(data[at + 2 : at + 2 + k].decode())
                at += 2 + k
            pos, many = struct.unpack_from("<IH", data, at)
            at += 6
            alleles = []
            for _ in range(many):
                k = struct.unpack_from("<I", data, at)[0]
                alleles.append(data[at + 4 : at + 4 + k].decode())
                at += 4 + k
            k = struct.unpack_from("<I", data, at)[0]
            body, at = data[at + 4 : at + 4 + k], at + 4 + k
            if flags & 3 == 1:
                body = zlib.decompress(body[4:])
            elif flags & 3 == 2:
                import zstandard

                body = zstandard.ZstdDecompressor().decompress(body[4:])
            ploidy = np.frombuffer(body, dtype=np.uint8, count=n, offset=8)
            bits, kept = body[8 + n + 1], np.arange(2) < (ploidy & 63)[:, None]
            raw = np.unpackbits(np.frombuffer(body, dtype=np.uint8, offset=10 + n), bitorder="little")[: int(kept.sum()) * bits]
            p = np.zeros((n, 3))
            p[:, :2][kept] = (raw.reshape(-1, bits).astype(np.int64) << np.arange(bits)).sum(axis=1) / ((1 << bits) - 1)
            p[np.arange(n), ploidy & 63] = 1 - p.sum(axis=1)
            p[ploidy >= 128] = np.nan
            yield {"names": tuple(words[:2]), "chrom": words[2], "pos": pos, "alleles": tuple(alleles), "ploidy": (ploidy & 63).tolist(), "gp": p}

    return samples, sites()
