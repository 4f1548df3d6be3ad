"""The star-schema tables read as genotype tables. SQL texts are the same rules for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, hap, allele): a haplotype per vector, a site per dimension."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("hap"), F.posexplode("embedding").alias("i", "x"))
    return e.select((F.col("i") + 1).alias("site"), "hap", F.expr("CAST(x > CAST(0.02*((i + 1) % 20) AS FLOAT) AS INT)").alias("allele"))


PANEL = """panel AS (
  SELECT i AS site, vec_id AS hap, CAST(embedding[i] > CAST(0.02*(i % 20) AS FLOAT) AS INT) AS allele
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i) s)"""


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, pos, ref, alt, ac, an): counted from the panel; every 16th site is an insertion."""
    g = panel(spark, sf_dir).groupBy("site").agg(F.sum("allele").alias("ac"), F.count("*").alias("an"))
    return g.select(
        "site", (F.col("site") * 1000 - F.when(F.col("site") % 10 == 5, 1000).otherwise(0)).alias("pos"), F.lit("A").alias("ref"), F.when(F.col("site") % 16 == 0, "AT").otherwise("C").alias("alt"), "ac", "an"
    )


SITES = """sites AS (
  SELECT site, site * 1000 - CASE WHEN site % 10 = 5 THEN 1000 ELSE 0 END AS pos, 'A' AS ref, CASE WHEN site % 16 = 0 THEN 'AT' ELSE 'C' END AS alt,
         sum(allele)::BIGINT AS ac, count(*) AS an
  FROM panel GROUP BY site)"""


def genotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, sample, truth, best, dp, gp0, gp1, gp2, ds): a cell per part and supplier; whole-number sums only."""
    cells = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("site"), F.col("l_suppkey").alias("sample"))
    sums = cells.agg(F.sum(F.col("l_quantity").cast("long")).alias("q"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("c"), F.count("*").alias("n"))
    best = (F.col("q") + (F.col("c") % 5 == 0).cast("int")) % 3
    p = (F.lit(50) + (F.col("q") * 7 + F.col("sample")) % 50) / F.lit(100.0)
    rest = F.lit(1.0) - F.col("p")
    x = sums.select("site", "sample", (F.col("q") % 3).cast("int").alias("truth"), best.cast("int").alias("best"), (F.lit(5) + F.col("q") % 20).cast("int").alias("dp"), p.alias("p"))
    gp = [F.when(F.col("best") == k, F.col("p")).when((F.col("best") + 1) % 3 == k, rest * F.lit(0.75)).otherwise(rest * F.lit(0.25)).alias(f"gp{k}") for k in range(3)]
    x = x.select("site", "sample", "truth", "best", "dp", *gp)
    return x.withColumn("ds", F.round(F.col("gp1") + 2 * F.col("gp2"), 3))


GENOTYPES = """cells AS (
  SELECT l_partkey AS site, l_suppkey AS sample, sum(l_quantity::BIGINT) AS q, sum(round(l_discount * 100)::BIGINT) AS c FROM lineitem GROUP BY ALL),
called AS (
  SELECT site, sample, (q % 3)::INT AS truth, ((q + CASE WHEN c % 5 = 0 THEN 1 ELSE 0 END) % 3)::INT AS best, (5 + q % 20)::INT AS dp,
         (50 + (q * 7 + sample) % 50)::DOUBLE / 100.0::DOUBLE AS p FROM cells),
shared AS (
  SELECT *, CASE WHEN best = 0 THEN p WHEN (best + 1) % 3 = 0 THEN (1.0::DOUBLE - p) * 0.75::DOUBLE ELSE (1.0::DOUBLE - p) * 0.25::DOUBLE END AS gp0,
         CASE WHEN best = 1 THEN p WHEN (best + 1) % 3 = 1 THEN (1.0::DOUBLE - p) * 0.75::DOUBLE ELSE (1.0::DOUBLE - p) * 0.25::DOUBLE END AS gp1,
         CASE WHEN best = 2 THEN p WHEN (best + 1) % 3 = 2 THEN (1.0::DOUBLE - p) * 0.75::DOUBLE ELSE (1.0::DOUBLE - p) * 0.25::DOUBLE END AS gp2 FROM called),
genotypes AS (SELECT site, sample, truth, best, dp, gp0, gp1, gp2, round(gp1 + 2 * gp2, 3) AS ds FROM shared)"""


def site_af(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, pos, maf, vtype, grp): frequencies of the parts."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("site"), (F.col("p_partkey") * 1000 + 1 + (F.col("p_partkey") * 37) % 500).alias("pos"), (F.col("p_size") / F.lit(100.0)).alias("maf"),
        F.when(F.col("p_partkey") % 8 == 0, "INDEL").otherwise("SNP").alias("vtype"), F.col("p_type").alias("grp"),
    )


SITE_AF = """site_af AS (
  SELECT p_partkey AS site, p_partkey * 1000 + 1 + (p_partkey * 37) % 500 AS pos, p_size / 100.0::DOUBLE AS maf,
         CASE WHEN p_partkey % 8 = 0 THEN 'INDEL' ELSE 'SNP' END AS vtype, p_type AS grp FROM part)"""


def gmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, cm): every seventh part is a knot."""
    p = table(spark, sf_dir, "part").filter("p_partkey % 7 = 0")
    return p.select((F.col("p_partkey") * 1000).alias("pos"), ((F.col("p_partkey") * 2 + F.expr("p_partkey div 70") * 5) / F.lit(100.0)).alias("cm"))


GMAP = """gmap AS (SELECT p_partkey * 1000 AS pos, (p_partkey * 2 + (p_partkey // 70) * 5) / 100.0::DOUBLE AS cm FROM part WHERE p_partkey % 7 = 0)"""


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, sample, pos, len, mapq, flags, mate_pos, base, qual): a read per event, 150 long at most."""
    e = table(spark, sf_dir, "events")
    bases = F.element_at(F.array(*(F.lit(b) for b in "ACGTN")), (F.crc32(F.col("event_type").cast("binary")) % 5 + 1).cast("int"))
    i = F.col("event_id")
    flags = F.when(i % 11 == 0, 4).when(i % 13 == 0, 256).when(i % 17 == 0, 1024).when(i % 19 == 0, 512).when(i % 5 == 0, F.lit(1 + 16)).when(i % 5 == 1, F.lit(1 + 32 + 2)).otherwise(0)
    return e.select(
        i.alias("read_id"), (F.col("user_id") % 10).alias("sample"), (i * 20 + 1).alias("pos"), (F.lit(50) + i % 100).cast("int").alias("len"), (i % 60).cast("int").alias("mapq"), flags.cast("int").alias("flags"),
        (i * 20 + 1 + (i % 7 - 3) * 40).alias("mate_pos"), bases.alias("base"), F.least(F.greatest(F.floor(F.col("value")), F.lit(4)), F.lit(60)).cast("int").alias("qual"),
    )


def variant_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, pos, ref, alt) for pileups: a site every 100 bases over the first 2,000 parts' span."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("site"), (F.col("p_partkey") * 100 + 50).alias("pos"), F.lit("A").alias("ref"), F.when(F.col("p_partkey") % 2 == 0, "C").otherwise("G").alias("alt"))


VARIANT_SITES = """variant_sites AS (SELECT p_partkey AS site, p_partkey * 100 + 50 AS pos, 'A' AS ref, CASE WHEN p_partkey % 2 = 0 THEN 'C' ELSE 'G' END AS alt FROM part)"""


def aligned_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(read_id, sample, pos, cigar, bases, quals): a read per event, whole or with an insertion, a deletion, a clipped end or a skipped stretch."""
    i = F.col("event_id")
    x = table(spark, sf_dir, "events").select(i.alias("read_id"), (F.col("user_id") % 10).alias("sample"), (i * 20 + 1).alias("pos"), (F.lit(40) + i % 60).cast("int").alias("n"), (i % 6).alias("shape"))
    # the first stretch ends at a site where it can
    x = x.withColumn("a", F.expr("CAST(CASE WHEN (150 - read_id * 20 % 100) % 100 BETWEEN 5 AND n - 10 THEN (150 - read_id * 20 % 100) % 100 ELSE 10 + read_id % 25 END AS INT)"))
    cigar = F.expr(
        "CASE shape WHEN 0 THEN concat(n, 'M') WHEN 1 THEN concat(a, 'M2I', n - a - 2, 'M') WHEN 2 THEN concat(a, 'M2D', n - a, 'M') WHEN 3 THEN concat('5S', n - 5, 'M') "
        "WHEN 4 THEN concat(a, 'M20N', n - a, 'M') ELSE concat(a, 'M1I', n - a - 1, 'M') END"
    )
    # the base at k is 'ACGT'[(read_id * 7 + k * 3 + k div 5) % 4], of period 20 in k; the quality is char(38 + (read_id + k * 11) % 36), of
    # period 36, and the read begins where 11 k is read_id (11 * 23 = 1 modulo 36): so both are cut from a few fixed strings
    turns = ["".join("ACGT"[(r + k * 3 + k // 5) % 4] for k in range(100)) for r in range(4)]
    bases = F.substr(F.element_at(F.array(*map(F.lit, turns)), (F.col("read_id") * 7 % 4 + 1).cast("int")), F.lit(1), F.col("n"))
    quals = F.substr(F.lit("".join(chr(38 + k * 11 % 36) for k in range(136))), (F.col("read_id") % 36 * 23 % 36 + 1).cast("int"), F.col("n"))
    return x.select("read_id", "sample", "pos", cigar.alias("cigar"), bases.alias("bases"), quals.alias("quals"))


def alignment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, value): those reads as lines of alignment text."""
    r = aligned_reads(spark, sf_dir)
    columns = ("read_id", F.lit(0), F.lit("chr1"), "pos", F.lit(60), "cigar", F.lit("*"), F.lit(0), F.lit(0), "bases", "quals")
    return r.select("sample", F.concat_ws("\t", *((F.col(c) if isinstance(c, str) else c).cast("string") for c in columns)).alias("value"))


# The same reads without strings: their matched stretches, one case a shape; base and quality at a place by their rules.
ALIGNED = """e AS (SELECT event_id AS read_id, user_id % 10 AS sample, event_id * 20 + 1 AS pos, 40 + event_id % 60 AS n, (150 - (event_id * 20) % 100) % 100 AS to_site, event_id % 6 AS shape FROM events),
r AS (SELECT *, CASE WHEN to_site BETWEEN 5 AND n - 10 THEN to_site ELSE 10 + read_id % 25 END AS a FROM e),
stretch AS (
  SELECT read_id, sample, n, pos AS first, CASE shape WHEN 0 THEN n WHEN 3 THEN n - 5 ELSE a END AS m, CASE shape WHEN 3 THEN 5 ELSE 0 END AS skipped, CASE shape WHEN 1 THEN 2 WHEN 2 THEN -2 WHEN 5 THEN 1 ELSE 0 END AS indel FROM r
  UNION ALL
  SELECT read_id, sample, n, pos + a + CASE shape WHEN 2 THEN 2 WHEN 4 THEN 20 ELSE 0 END, n - a - CASE shape WHEN 1 THEN 2 WHEN 5 THEN 1 ELSE 0 END, a + CASE shape WHEN 1 THEN 2 WHEN 5 THEN 1 ELSE 0 END, 0 FROM r WHERE shape IN (1, 2, 4, 5)),
spots AS (
  SELECT read_id, sample, n, site, ref, alt, skipped + pos - first AS off, CASE WHEN pos = first + m - 1 THEN indel ELSE 0 END AS read_indel FROM stretch JOIN any_sites ON pos >= first AND pos < first + m),
evidence AS (
  SELECT *, substr('ACGT', (read_id * 7 + off * 3 + off // 5) % 4 + 1, 1) AS base, substr('ACGT', (read_id * 7 + (off + 1) * 3 + (off + 1) // 5) % 4 + 1, 1) AS base1, substr('ACGT', (read_id * 7 + (off + 2) * 3 + (off + 2) // 5) % 4 + 1, 1) AS base2,
         (5 + (read_id + off * 11) % 36)::INT AS qual, 5 + (read_id + (off + 1) * 11) % 36 AS qual1, 5 + (read_id + (off + 2) * 11) % 36 AS qual2, n - off AS room FROM spots)"""


def any_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, pos, ref, alt): SNPs, insertions of one and two bases and deletions of two, a site every 100 bases."""
    k = F.col("p_partkey") % 5
    p = table(spark, sf_dir, "part")
    ref, alt = F.when(k == 1, "ACG").when(k == 2, "C").otherwise("A"), F.when(k == 0, "ATT").when(k == 1, "A").when(k == 2, "CA").otherwise("G")
    return p.select(F.col("p_partkey").alias("site"), (F.col("p_partkey") * 100 + 50).alias("pos"), ref.alias("ref"), alt.alias("alt"))


ANY_SITES = """any_sites AS (SELECT p_partkey AS site, p_partkey * 100 + 50 AS pos, CASE p_partkey % 5 WHEN 1 THEN 'ACG' WHEN 2 THEN 'C' ELSE 'A' END AS ref,
  CASE p_partkey % 5 WHEN 0 THEN 'ATT' WHEN 1 THEN 'A' WHEN 2 THEN 'CA' ELSE 'G' END AS alt FROM part)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
