"""Binary probabilities: bytes by hand, rounding, round trips."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import posterior
from strandlake.sources import bgen


def test_bytes_of_a_small_file():
    block = bgen.variant(("v", "r"), "1", 7, ("A", "C"), np.array([[1.0, 0.0, 0.0], [0.0, 0.5, 0.5], [np.nan] * 3]), np.array([2, 2, 2]), 8, "none")
    data = struct.pack("<IHBB", 3, 2, 2, 2) + bytes([2, 2, 130, 0, 8]) + bytes([255, 0, 0, 128, 0, 0])
    assert block == b"\x01\x00v\x01\x00r\x01\x001" + struct.pack("<IH", 7, 2) + struct.pack("<I", 1) + b"A" + struct.pack("<I", 1) + b"C" + struct.pack("<I", len(data)) + data
    head = bgen.header(1, ["a", "bc"], "zlib")
    assert head == struct.pack("<I", 20 + 15) + struct.pack("<III", 20, 1, 2) + b"bgen" + struct.pack("<I", 1 | 8 | 1 << 31) + struct.pack("<II", 15, 2) + b"\x01\x00a\x02\x00bc"


@pytest.mark.parametrize("bits", [1, 3, 8, 16, 31, 32])
def test_rounding_keeps_the_sum(bits):
    rng = np.random.default_rng(bits)
    p = rng.dirichlet([0.3, 0.3, 0.3], 500)
    q = bgen.quantised(p, bits)
    assert (q.sum(axis=1) == (1 << bits) - 1).all() and (q >= 0).all() and np.abs(q - p * ((1 << bits) - 1)).max() < 1.0001


@pytest.mark.parametrize(("bits", "compression"), [(8, "zlib"), (16, "none"), (11, "zstd"), (1, "zlib")])
def test_round_trip(spark, tmp_path, bits, compression):
    rng = np.random.default_rng(9)
    names, n = ["s1", "s2", "s3", "s4"], 40
    sites = spark.createDataFrame([(i, 1000 - 7 * i, f"r{i}" if i % 3 else None, "A", "CT" if i % 4 else "G") for i in range(n)], "site int, pos int, id string, ref string, alt string")
    rows = []
    for i in range(n):
        for k, s in enumerate(names[:3]):  # the fourth sample has no cells
            p = rng.dirichlet([1, 1, 1]) if k < 2 else np.array([*rng.dirichlet([1, 1]), 0.0])
            rows.append((i, s, p.tolist(), 2 if k < 2 else 1))
    called = spark.createDataFrame(rows, "site int, sample string, gp array<double>, ploidy int").repartition(5)
    core = posterior.in_core(sites, 800, 990)
    path = str(tmp_path / "out.bgen")
    bgen.write(bgen.blocks(core, called, names, "chr7", bits, compression), path, names, compression)
    samples, found = bgen.read((tmp_path / "out.bgen").read_bytes())
    found = list(found)
    expected = [i for i in range(n) if 800 <= 1000 - 7 * i <= 990]
    assert samples == names and [r["pos"] for r in found] == sorted(1000 - 7 * i for i in expected)
    p = {(i, s): g for i, s, g, _ in rows}
    for r in found:
        i = (1000 - r["pos"]) // 7
        assert r["chrom"] == "chr7" and r["names"] == (f"chr7:{r['pos']}_A_{'CT' if i % 4 else 'G'}", f"r{i}" if i % 3 else ".") and r["ploidy"] == [2, 2, 1, 2]
        assert np.isnan(r["gp"][3]).all()
        for k, s in enumerate(names[:3]):
            assert np.abs(r["gp"][k] - p[i, s]).max() <= 1.0 / ((1 << bits) - 1) + 1e-12
    assert bgen.blocks(core.filter(F.lit(False)), called, names, "chr7").count() == 0
    with pytest.raises(ValueError):
        bgen.blocks(core, called, names, "chr7", 33)
