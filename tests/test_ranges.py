"""Work on ranges of positions gives what one range would, and windows of a chromosome what their definitions say."""

import os
import subprocess
import sys
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import chunking, gmap, ranges, sites


def some_sites(spark, seed, chrom):
    rng = np.random.default_rng(seed)
    rows = [(c, i, int(p), "A", "C" if i % 5 else "AT", int(rng.integers(0, 11)), 10) for c in ("1", "2") for i, p in enumerate(np.sort(rng.integers(1, 9000, 120)))]
    df = spark.createDataFrame(rows, "chrom string, site int, pos long, ref string, alt string, ac long, an long").repartition(4)
    return df if chrom else df.filter("chrom = '1'").drop("chrom")


@pytest.mark.parametrize("chrom", [True, False])
@pytest.mark.parametrize("width", [50, 1000, 1 << 20])
def test_interpolation(spark, monkeypatch, chrom, width):
    monkeypatch.setattr(ranges, "WIDTH", width)
    rng = np.random.default_rng(5)
    s = some_sites(spark, 4, chrom)
    knots = [(c, int(p), float(v)) for c in ("1", "2") for p, v in zip(np.sort(rng.choice(np.arange(2000, 7000), 12, replace=False)), np.sort(rng.random(12)), strict=True)]
    knots += [(c, p, v + 1) for c, p, v in knots[:3]]  # the least of several counts
    m = spark.createDataFrame(knots, "chrom string, pos long, cm double")
    m = m if chrom else m.filter("chrom = '1'").drop("chrom")
    found = gmap.interpolate(s, m).collect()
    assert len(found) == s.count()
    for r in found:
        c = r["chrom"] if chrom else "1"
        own = sorted((p, v) for k, p, v in knots[:24] if k == c)
        x, y = np.array([p for p, _ in own], float), np.array([v for _, v in own])
        rate = (y[-1] - y[0]) / (x[-1] - x[0])
        p = r["pos"]
        want = y[0] - (x[0] - p) * rate if p < x[0] else y[-1] + (p - x[-1]) * rate if p > x[-1] else np.interp(p, x, y)
        assert r["cm"] == pytest.approx(want, abs=1e-9)


def test_interpolation_far_from_any_knot(spark):
    s = spark.createDataFrame([(p,) for p in (5, 3 << 20, 9 << 20, 40 << 20, None)], "pos long")
    m = spark.createDataFrame([(4 << 20, 1.0), (8 << 20, 5.0)], "pos long, cm double")
    found = {r["pos"]: r["cm"] for r in gmap.interpolate(s, m).collect()}
    rate = 4.0 / (4 << 20)
    assert found[9 << 20] == pytest.approx(5 + (1 << 20) * rate) and found[3 << 20] == pytest.approx(1 - (1 << 20) * rate) and found[40 << 20] == pytest.approx(5 + (32 << 20) * rate) and found[None] is None


@pytest.mark.parametrize("chrom", [True, False])
def test_indexes_and_groups(spark, monkeypatch, chrom):
    def run(width):
        monkeypatch.setattr(ranges, "WIDTH", width)
        x = sites.classify(some_sites(spark, 8, chrom), sites.SiteOptions(sparse_maf=0.2)).withColumn("cm", F.col("pos") / 700.0)
        x = chunking.selection_groups(sites.index_sites(x), 0.5)
        return sorted(map(str, x.select(*sorted(x.columns)).collect())), x

    whole, x = run(1 << 40)
    assert run(100)[0] == whole and run(3000)[0] == whole
    # against plain loops
    for c in ("1", "2") if chrom else ("1",):
        rows = (x.filter(F.col("chrom") == c) if chrom else x).orderBy("pos", "site").collect()
        common, last, group = 0, None, -1
        for k, r in enumerate(rows):
            assert r["site_idx"] == k and r["all2common"] == common and r["common_idx"] == (common if r["is_common"] else None)
            common += r["is_common"]
            if r["is_common"] and not r["lq"]:
                step = int(np.floor(r["cm"] / 0.5 + 0.5))
                group += last is None or step != last
                last = step
                assert r["grp"] == group
            else:
                assert r["grp"] is None


def chromosome(seed, n=300):
    rng = np.random.default_rng(seed)
    pos = np.sort(rng.choice(np.arange(1, 20 * n), n, replace=False))
    cm = np.cumsum(np.where(rng.random(n) < 0.3, 0.0, rng.random(n) * 0.02))  # with stretches of equal values
    return pos, np.round(cm, 2) if seed % 2 else cm, rng.integers(0, 2, n)


OPTIONS = [
    chunking.ChunkOptions(window_cm=0.2, window_mb=0.0004, window_count=20, buffer_cm=0.05, buffer_mb=0.0001, buffer_count=5),
    chunking.ChunkOptions(window_cm=0.01, window_mb=0.001, window_count=5, buffer_cm=0.0, buffer_mb=0.0005, buffer_count=1),
    chunking.ChunkOptions(window_cm=0.0, window_mb=0.0, window_count=40, buffer_cm=1.5, buffer_mb=0.0, buffer_count=1, exact_buffer=False),
    chunking.ChunkOptions(window_cm=50.0, window_mb=0.0, window_count=40, buffer_cm=0.1, buffer_mb=0.0, buffer_count=3),
]


def windows_by_hand(pos, cm, common, o, length):
    """Rows of the table of windows, by their definitions."""
    n = len(pos)

    def long_enough(a, b, count):
        return cm[b] - cm[a] >= o.window_cm and pos[b] - pos[a] >= o.window_mb * 1e6 and b - a + 1 >= count

    def halves(a, b):
        m = (a + b) // 2
        ok = b - a >= 2 and min(common[a : m + 1].sum(), common[m + 1 : b + 1].sum()) > o.window_count and long_enough(a, m, 1) and long_enough(m + 1, b, 1)
        return halves(a, m) + halves(m + 1, b) if ok else [(a, b)]

    def sequence(count):
        """Each window ends at the first site with enough common sites, length and sites; a short rest joins the last."""
        out, a = [], 0
        while a < n:
            b = next((b for b in range(a, n) if common[a : b + 1].sum() >= count and long_enough(a, b, count)), n - 1)
            rest = n - 1 - b
            if rest and (cm[-1] - cm[b] < o.buffer_cm or pos[-1] - pos[b] < o.buffer_mb * 1e6 or rest < o.buffer_count):
                b = n - 1
            out.append((a, b))
            a = b + 1
        return out

    if o.recursive:
        found = halves(0, n - 1)
    else:
        count = o.window_count
        while True:
            found = sequence(count)
            if len(found) == 1 or long_enough(*found[-1], o.window_count):
                break
            count += 100
            if count > n:
                found = halves(0, n - 1)
                break
        if o.uniform and len(found) > 1:
            mean = -(-n // len(found))
            again = [(i, min(i + mean, n) - 1) for i in range(0, n, mean)]
            if all(long_enough(a, b, 1) for a, b in again):
                found = again
    rows = []
    for k, (a, b) in enumerate(found):
        def met(i, j):
            gap = abs(cm[j] - cm[i])
            return (gap if o.exact_buffer else np.floor(gap)) >= o.buffer_cm and abs(pos[j] - pos[i]) >= o.buffer_mb * 1e6 and abs(i - j) >= o.buffer_count

        left, right = next((j for j in range(a - 1, -1, -1) if met(a, j)), 0), next((j for j in range(b + 1, n) if met(b, j)), n - 1)
        rows.append((k, 1 if a == 0 else pos[left], length if b == n - 1 else pos[right], 1 if a == 0 else pos[a], length if b == n - 1 else pos[b], cm[b] - cm[a], pos[b] - pos[a] + 1, b - a + 1, common[a : b + 1].sum()))
    return [tuple(map(float, r)) for r in rows]


@pytest.mark.parametrize(("o", "kind"), [(0, {}), (1, {}), (2, {}), (3, {}), (0, {"recursive": True}), (1, {"recursive": True}), (0, {"uniform": True}), (2, {"uniform": True})])
def test_windows_by_definition(spark, o, kind):
    """Three chromosomes at once, in ranges of 16 places (pointers are doubled over 20 of them) and in one."""
    o = replace(OPTIONS[o], **kind)
    some = {f"c{k}": chromosome(k, n) for k, n in ((1, 300), (2, 317), (3, 9))}
    rows = [(c, int(p), float(x), bool(m)) for c, v in some.items() for p, x, m in zip(*v, strict=True)]
    sites = spark.createDataFrame(rows, "chrom string, pos int, cm double, is_common boolean").repartition(3)
    for per_range in (16,) if kind else (16, 1 << 14):
        found = {}
        for r in chunking.chunk(sites, o, {"c1": 10_000}, per_range).orderBy("chrom", "chunk").collect():
            found.setdefault(r["chrom"], []).append(tuple(map(float, r[1:])))
        for c, v in some.items():
            assert found[c] == windows_by_hand(*v, o, 10_000 if c == "c1" else chunking.NO_LENGTH)


def test_no_sites_no_windows(spark):
    assert chunking.chunk(spark.createDataFrame([], "chrom string, pos int, cm double, is_common boolean")).count() == 0


def test_tasks_grow_with_ranges(spark):
    """No task has more places than a range, whatever the chromosome's."""
    pos, cm, common = chromosome(4, 2_000)
    sites = spark.createDataFrame([("c", int(p), float(x), bool(m)) for p, x, m in zip(pos, cm, common, strict=True)], "chrom string, pos int, cm double, is_common boolean")
    p = chunking.Places(sites, 64)
    assert p.rows.groupBy("chrom", "range").count().agg({"count": "max"}).first()[0] == 64 and len(p.ends["c"]) == 32


def before_a_gap(spark):
    """60 ranges of 16 places that all reach the first place behind a gap, whose own 40 reach none."""
    pos = np.append(np.arange(1, 961), np.arange(1_000_001, 1_000_041))
    sites = spark.createDataFrame([("c", int(p), float(p) / 1e6, True) for p in pos], "chrom string, pos int, cm double, is_common boolean")
    p = chunking.Places(sites, 16)
    queries = p.rows.select("chrom", "idx", "pos", "cm", (F.col("upto") - F.col("c")).alias("before"))
    return p, queries


@pytest.mark.parametrize("back", [False, True])
def test_many_places_that_reach_one_range(spark, back):
    """No group has more than the places of two ranges, and each place asks once."""
    p, queries = before_a_gap(spark)
    need = chunking.Need(0.5, 5e5, 1)
    sizes = p.dealt(queries, need, back=back).groupBy("chrom", "source", "range").agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("int")).alias("asks")).collect()
    assert max(r["n"] for r in sizes) <= 32 and max(r["asks"] for r in sizes) == 16 and sum(r["asks"] for r in sizes) == 1000
    found = {r["idx"]: r["at"] for r in p.reached(queries, need, back=back).collect()}
    assert found == {i: (0 if i < 960 else 959) if back else (960 if i < 960 else 999) for i in range(1000)}


def test_one_kind_of_worker(spark):
    """All that Python does takes Arrow, so that executors have a worker a core; small tables pass through none."""
    p, queries = before_a_gap(spark)
    o, counts = chunking.ChunkOptions(window_cm=0.0, window_mb=0.0001, window_count=20, buffer_cm=0.0, buffer_mb=0.0, buffer_count=5), {"c": 20}
    opened = p.opened(counts, o)
    for x in (p.reached(queries, chunking.Need(0.5, 5e5, 3)), opened, p.chain(opened)):
        plan = x._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInArrow" in plan and "Pandas" not in plan
    for x in (p.pairs(chunking.Need(0.5, 5e5, 3)), p.whole(["c"])):
        assert "PythonRDD" not in x._jdf.queryExecution().toRdd().toDebugString()


POOLS = """
import subprocess, sys
from pyspark.sql import SparkSession
from strandlake.plans import catalog

conf = {"spark.sql.shuffle.partitions": "3", "spark.ui.enabled": "false", "spark.checkpoint.dir": sys.argv[2]}
spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
catalog.queries()["win_12_uniform_windows"](spark, sys.argv[1]).collect()
jvm = spark._jvm.java.lang.ProcessHandle.current().pid()
lines = [x.split(None, 2) for x in subprocess.run(["ps", "-eo", "pid,ppid,args"], capture_output=True, text=True, check=True).stdout.splitlines()]
print("pools", sum(int(parent) == jvm and "pyspark.daemon" in args for _, parent, args in lines[1:]))
"""


def test_uniform_windows_take_one_pool(tmp_path, sf_dir):
    """The whole query in a session of its own: each pool of workers would keep its idle ones, so that an executor has more than one a core."""
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parent.parent)}
    out = subprocess.run([sys.executable, "-c", POOLS, sf_dir, str(tmp_path / "checkpoints")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300, check=True).stdout
    assert out.split()[-2:] == ["pools", "1"]
