"""Reads along their alignments against a walk base by base; indel evidence by hand."""

import random
import re

import pytest
from pyspark.sql import functions as F

from strandlake.functions import genotypes as G
from strandlake.operators import pileup


def walk(pos, cigar, bases, quals):
    """{reference position: (base, qual, indel)} of the bases of a read; deleted and skipped positions have none."""
    ops = [(o, int(n)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
    out, at = {}, 0
    for k, (op, n) in enumerate(ops):
        if op in "M=X":
            for i in range(n):
                after = ops[k + 1] if i == n - 1 and k + 1 < len(ops) else ("", 0)
                out[pos] = (bases[at], ord(quals[at]) - 33, {"I": after[1], "D": -after[1]}.get(after[0], 0))
                pos, at = pos + 1, at + 1
        elif op in "DN":
            pos += n
        elif op in "IS":
            at += n
    return out


def some_reads(seed, n):
    rng = random.Random(seed)
    for i in range(n):
        middle = [f"{rng.randint(1, 9)}{rng.choice('MIDNX=')}" for _ in range(rng.randint(1, 6))]
        cigar = ("3H" if i % 5 == 0 else "") + (f"{rng.randint(1, 4)}S" if i % 3 == 0 else "") + "4M" + "".join(middle) + "5M"
        length = sum(int(n) for n, o in re.findall(r"(\d+)([MIS=X])", cigar))
        yield (i, "s", rng.randint(1, 60), cigar, "".join(rng.choice("ACGTN") for _ in range(length)), "".join(chr(33 + rng.randint(0, 60)) for _ in range(length)))


READS = "read_id long, sample string, pos long, cigar string, bases string, quals string"


def test_bases_along_the_alignment(spark):
    rows = list(some_reads(3, 80)) + [(900, "s", 5, "*", "*", "*"), (901, "s", 5, None, None, None)]
    sites = spark.createDataFrame([(p, p, "A", "C") for p in range(1, 140)], "site long, pos long, ref string, alt string")
    pile = pileup.pile_up(spark.createDataFrame(rows, READS), sites, 16)
    found = {(r["read_id"], r["pos"]): (r["base"], r["qual"], r["read_indel"]) for r in pile.filter("base IS NOT NULL").collect()}
    assert found == {(i, p): v for i, _, pos, cigar, bases, quals in rows[:80] for p, v in walk(pos, cigar, bases, quals).items() if p < 140}
    assert pile.filter("op IN ('D', 'N') AND base IS NOT NULL").count() == 0
    used = {(r["read_id"], r["pos"]) for r in pileup.usable_bases(pile).collect()}
    assert used == {k for k, (b, q, _) in found.items() if b in "ACGT" and q >= 10}


def test_indel_evidence(spark):
    q = "5" * 12  # 20
    rows = [
        (0, "s", 1, "10M", "GGGGACGGGG", q[:10]),  # reference at the insertion; not the deleted bases' reference
        (1, "s", 1, "5M2I5M", "GGGGATTGGGGG", q),  # inserts TT
        (2, "s", 1, "5M2I5M", "GGGGACTGGGGG", q),  # inserts other bases
        (3, "s", 1, "5M1I5M", "GGGGATGGGGG", q[:11]),  # inserts too little
        (4, "s", 1, "5M2D5M", "GGGGAGGGGG", q[:10]),  # deletes two
        (5, "s", 1, "10M", "GGGGATTGGG", q[:10]),  # shows the bases that may be deleted
        (6, "s", 1, "6M", "GGGGAT", q[:6]),  # as far as the read goes
        (7, "s", 1, "10M", "GGGGCTTGGG", q[:10]),  # another anchor
        (8, "s", 1, "10M", "GGGGATTGGG", "5555%%%555"),  # poor bases
    ]
    sites = spark.createDataFrame([(1, 5, "A", "ATT"), (2, 5, "ATT", "A")], "site long, pos long, ref string, alt string")
    found = {(r["site"], r["read_id"]): r["base"] for r in pileup.usable_evidence(pileup.pile_up(spark.createDataFrame(rows, READS), sites)).collect()}
    assert found == {(1, 0): "A", (1, 1): "ATT", (1, 5): "A", (1, 6): "A", (2, 4): "A", (2, 5): "ATT", (2, 6): "ATT"}


@pytest.mark.parametrize("ploidy", [1, 2])
def test_indel_likelihoods(spark, ploidy):
    rows = [(i, "s", 1, "5M2I5M" if i < 3 else "10M", "GGGGATTGGGGG" if i < 3 else "GGGGACGGGG", "5" * (12 if i < 3 else 10)) for i in range(4)]
    sites = spark.createDataFrame([(1, 5, "A", "ATT")], "site long, pos long, ref string, alt string")
    r = pileup.likelihoods(pileup.usable_evidence(pileup.pile_up(spark.createDataFrame(rows, READS), sites)), ploidy).first()
    import math

    e = 10 ** -2.0
    same, half, other = math.log10(1 - e), math.log10(0.5 - e / 3), math.log10(e / 3 if ploidy == 2 else e)
    ll = [same + 3 * other, 4 * half, 3 * same + other] if ploidy == 2 else [same + 3 * other, 3 * same + other]
    assert r["depth"] == 4 and r["pl"] == [min(255, math.floor(round(10 * (max(ll) - x), 6))) for x in ll]


def test_poisson_beyond_twenty(spark):
    import math

    df = spark.range(0, 45).select(F.col("id").alias("n"), G.poisson(F.col("id"), F.lit(12.5)).alias("p"), G.poisson(F.col("id"), F.lit(0.0)).alias("z"))
    for r in df.collect():
        assert math.isclose(r["p"], math.exp(r["n"] * math.log(12.5) - 12.5 - math.lgamma(r["n"] + 1)), rel_tol=1e-9) and r["z"] == (1.0 if r["n"] == 0 else 0.0)


def test_deep_sites_are_dealt_over_tasks(spark):
    """A site with most of the reads: dealt by reads, its likelihoods as without."""
    rng = random.Random(5)
    rows = [(i, f"s{i % 3}", 1_000 if i % 10 else 1 + i * 13 % 5_000, "10M2I20M" if i % 4 else "30M", "".join(rng.choices("ACGT", k=32 if i % 4 else 30)), "5" * (32 if i % 4 else 30)) for i in range(4_000)]
    reads = spark.createDataFrame(rows, READS).repartition(4)
    sites = spark.createDataFrame([(i, i * 11 + 2, "A", "C" if i % 5 else "ATT") for i in range(450)], "site long, pos long, ref string, alt string")
    plain, dealt = (pileup.pile_up(reads, sites, 64, deep).cache() for deep in (None, 200))
    keys = ("read_id", "site", "offset", "base", "qual", "read_indel", "left")
    assert sorted(map(tuple, plain.select(*keys).collect())) == sorted(map(tuple, dealt.select(*keys).collect()))
    one, two = (sorted(map(tuple, pileup.likelihoods(pileup.usable_evidence(x)).select("sample", "site", "depth", "pl").collect())) for x in (plain, dealt))
    assert one == two and max(r[2] for r in one) > 200
    pieces = pileup.pieces(reads, 64, 0)
    deep = pileup.deep_blocks(pieces, 200)
    parts = {r["block"]: r["parts"] for r in deep.collect()}
    assert parts[1_000 // 64] >= 18 and pileup.deep_blocks(pieces, 1 << 40) is None
    n = pieces.join(deep, "block").groupBy("block", F.pmod(F.xxhash64("read_id", "read_pos"), F.col("parts"))).count().agg(F.max("count")).first()[0]
    assert n < 2 * 200
    a, b = (pileup.cover(reads.withColumn("len", F.lit(30)), sites, 64, deep).select("read_id", "site").collect() for deep in (None, 200))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_missing_bases_and_qualities(spark):
    rows = [(1, "s", 5, "4M", "ACGT", "*"), (2, "s", 5, "4M", "*", "*"), (3, "s", 5, "1M3D1M2I1M", "ACGTA", "*+5*5")]
    sites = spark.createDataFrame([(p, p, "A", "C") for p in range(1, 20)], "site long, pos long, ref string, alt string")
    found = {(r["read_id"], r["pos"]): (r["base"], r["qual"]) for r in pileup.pile_up(spark.createDataFrame(rows, READS), sites, 4).filter("base IS NOT NULL").collect()}
    assert found == {(1, 5): ("A", 255), (1, 6): ("C", 255), (1, 7): ("G", 255), (1, 8): ("T", 255), (3, 5): ("A", 9), (3, 9): ("C", 10), (3, 10): ("A", 20)}
