"""Operator 2: a mix of sources at target weights by systematic sampling; DataFrame functions only.

Within a source, documents stand in order of size class, salt and size, so that neighbours are of like size and what one takes
too much the next takes less; the prefix sums of their expected copies, plus one random offset for the source (seeded), are cut
at the integers, and a document is emitted once per integer that its step crosses.

What such a pass misses is about its largest document. So there are strata: size classes whose largest document has more
than a share of the source's target (LARGE, several) are sampled first, at the source's rate (target over size); the next stratum
stands at the rate that brings the source to its target from there, within 0 and MOST copies, and so on. What a stratum misses is made
good by those after it, so a source misses its target by about the last share, unless the smaller documents are too few to make
good what the larger ones missed (a source of a few documents, or without small ones).

The rank of a document within its source is put together from counts of (source, size class, salt)
groups and a rank within the group, so no source, however large, meets in one task; the number of
salts follows the number of rows. Documents of a source before the last stratum are few: about its size over the last share of its target at most.

Defined results: null texts have size 0; the null source is a source of its own, last; documents of
size 0 take part with 0 words; a source of size 0 has target 0 and takes nothing; ties and repeated
rows are ordered by doc_id, and equal rows get interchangeable results; a very long text is a document like
others, its words are counted whole; an empty table gives an empty result; other columns are ignored, whatever
their names (`mixed` keeps them; of rows with equal doc_id, source and text that differ elsewhere, the one with the least hash
of the whole row stands for all).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WEIGHTS = (5, 2, 1)
#: No source's target, and no document, exceeds so many times its size.
MOST = 3
#: Strata: size classes with a document above such a share of their source's target come before the others.
LARGE = (0.2, 0.07, 0.025, 0.01)
#: Rows of a source and size class are dealt to salts of about so many.
SALT_ROWS = 2_000
SEED = "mix-1"
WORDS = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    """Eight classes for each power of two; equal for 0."""
    bits = F.length(F.bin(size))
    fine = F.call_function("div", size * 8, F.call_function("shiftleft", F.lit(1).cast("long"), bits - 1))
    return F.when(size > 0, bits * 8 + fine - 8).otherwise(0).cast("int")


def hashed(value: Column) -> Column:
    """32 bits of md5, as a number that other SQL engines also give."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("long")


def jitter(source: Column) -> Column:
    return hashed(F.concat(F.lit(SEED + "|"), F.coalesce(source, F.lit("")), F.when(source.isNull(), "|null").otherwise("|"))) / F.lit(float(1 << 32))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """sizes with rank, from 0, in code point order of source, null last; by ranges, as there may be many sources."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = common.cut_lineage(sizes.repartitionByRange(common.partitions(sizes.sparkSession), *order).withColumn("range", F.spark_partition_id()))
    per = dealt.groupBy("range").agg(F.count("*").alias("n"))  # a row a range
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order)) - 1
    return dealt.withColumn("own", own).join(starts, "range").withColumn("rank", F.col("start") + F.col("own")).drop("own", "start", "range")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sizes (source, source_size) with weight and target. One row a source.

    Weights go round in code point order, null last. Capped sources stop at most * size; what they
    leave is shared by weight until no other is above. Each round is one aggregate over the sources.
    """
    weighed = ranked_sources(sizes).withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))).drop("rank")
    weighed = common.cut_lineage(weighed)
    total = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]
    capped_size, capped_weight = 0, 0
    all_weight = weighed.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()["w"]
    while True:
        rest, share = total - most * capped_size, all_weight - capped_weight
        # weights are 32 bits wide and totals may be: products of billions of words need more
        full = F.col("weight").cast("decimal(10,0)") * F.lit(rest).cast("decimal(20,0)") >= F.col("source_size").cast("decimal(20,0)") * F.lit(most * share).cast("decimal(17,0)")
        found = weighed.filter(full).agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("s"), F.coalesce(F.sum("weight"), F.lit(0)).alias("w")).first()
        if (found["s"], found["w"]) == (capped_size, capped_weight) or share <= 0:
            break
        capped_size, capped_weight = found["s"], found["w"]
    if share <= 0:
        return weighed.withColumn("target", (F.col("source_size") * most).cast("double"))
    return weighed.withColumn("target", F.when(full, (F.col("source_size") * most).cast("double")).otherwise((F.col("weight").cast("decimal(10,0)") * F.lit(rest).cast("decimal(20,0)")).cast("double") / F.lit(float(share))))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, text_hash."""
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")
    )
    # the narrow table is read several times; texts are read once
    sized = common.cut_lineage(sized)
    n = sized.count()
    salts = 1 + n // SALT_ROWS
    rows = sized.withColumn("class", size_class(F.col("size"))).withColumn("salt", F.pmod(hashed(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(salts)))
    rows = rows.withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))

    groups = rows.groupBy("src", "source", "class", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.max("size").alias("most"))
    by_class = groups.groupBy("src", "source", "class").agg(F.sum("n").alias("class_n"), F.sum("words").alias("class_words"), F.max("most").alias("class_most"))
    sizes = by_class.groupBy("src", "source").agg(F.sum("class_words").alias("source_size"))
    aimed = targets(sizes, weights, most)
    aimed = common.cut_lineage(aimed.select("src", "source_size", "target", jitter(F.col("source")).alias("jitter")))

    by_class = by_class.join(aimed, "src").withColumn("stratum", sum((F.col("class_most") <= F.lit(x) * F.col("target")).cast("int") for x in LARGE))
    before = Window.partitionBy("src", "stratum").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    by_class = by_class.withColumn("class_start", F.coalesce(F.sum("class_n").over(before), F.lit(0)))
    within = Window.partitionBy("src", "class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("salt_start", F.coalesce(F.sum("n").over(within), F.lit(0))).drop("source", "n", "words", "most")
    starts = starts.join(by_class.drop("source"), ["src", "class"])
    starts = common.cut_lineage(starts.select("src", "class", "salt", (F.col("class_start") + F.col("salt_start")).alias("start"), "source_size", "target", "jitter", "stratum"))

    def ranked(some: DataFrame) -> DataFrame:
        own = Window.partitionBy("src", "class", "salt").orderBy("size", "doc_id")
        return rows.join(some, ["src", "class", "salt"]).withColumn("rank", F.col("start") + F.row_number().over(own))

    large = common.cut_lineage(ranked(starts.filter(F.col("stratum") < len(LARGE))).select("src", "stratum", "size", "rank", "jitter"))
    rated = aimed.withColumns({"had": F.lit(0).cast("long"), "done": F.lit(0).cast("long")})
    for k in range(len(LARGE) + 1):
        left = F.col("source_size") - F.col("done")
        rate = F.when(left > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), (F.col("target") - F.col("had")) / left))).otherwise(0.0)
        rated = rated.withColumn(f"rate{k}", rate)
        if k < len(LARGE):
            part = large.filter(F.col("stratum") == k).join(rated.select("src", F.col(f"rate{k}").alias("rate")), "src")
            part = part.groupBy("src").agg(F.sum(crossed(most) * F.col("size")).alias("more"), F.sum("size").alias("size"))
            rated = rated.join(part, "src", "left").withColumns({"had": F.col("had") + F.coalesce("more", F.lit(0)), "done": F.col("done") + F.coalesce("size", F.lit(0))}).drop("more", "size")
    rates = rated.select("src", F.posexplode(F.array(*(f"rate{k}" for k in range(len(LARGE) + 1)))).alias("stratum", "rate"))
    taken = ranked(starts.join(rates, ["src", "stratum"])).withColumn("copies", crossed(most))
    return taken.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "text_hash")


def crossed(most: int) -> Column:
    """Integers that a document's step crosses, from rank, rate and jitter."""
    steps = F.floor(F.col("jitter") + F.col("rank") * F.col("rate")) - F.floor(F.col("jitter") + (F.col("rank") - 1) * F.col("rate"))
    return F.least(steps, F.lit(most)).cast("long")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it, with the columns of docs as they are."""
    key, source, text, copies, copy = common.fresh(docs, "key", "source_key", "text_hash", "copies", "copy")
    keys = {key: F.coalesce(F.col("doc_id").cast("string"), F.lit("")), source: F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))}
    wanted = mix(docs, weights, most).select(*(c.alias(k) for k, c in keys.items()), F.col("text_hash").alias(text), F.col("copies").alias(copies))
    wanted = wanted.groupBy(key, source, text).agg(F.sum(copies).alias(copies)).filter(F.col(copies) > 0)
    keyed = docs.withColumns(keys).withColumn(text, F.xxhash64("text"))
    (row,) = common.fresh(docs, "row")
    one = keyed.groupBy(key, source, text).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(row))
    chosen = one.join(wanted, [key, source, text]).select(f"{row}.*", copies)
    return chosen.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).select(*docs.columns)


def oracle(weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> str:
    """DuckDB SQL for doc_id, size, source_size, target, taken."""
    listed = ", ".join(map(str, weights))
    steps = f"least(floor(r.jitter + r.rank * t.rate) - floor(r.jitter + (r.rank - 1) * t.rate), {most})::BIGINT"
    strata = ""
    for k in range(len(LARGE) + 1):
        strata += f"""step{k} AS (SELECT *, CASE WHEN source_size > done THEN greatest(0.0::DOUBLE, least({most}.0::DOUBLE, (target - had) / (source_size - done)::DOUBLE)) ELSE 0.0::DOUBLE END AS rate FROM rated{k}),
had{k} AS (SELECT r.source, sum({steps} * r.size)::BIGINT AS more, sum(r.size)::BIGINT AS size FROM ranked r JOIN step{k} t ON r.source IS NOT DISTINCT FROM t.source WHERE r.stratum = {k} GROUP BY r.source),
rated{k + 1} AS (SELECT s.source, s.target, s.source_size, s.had + coalesce(h.more, 0) AS had, s.done + coalesce(h.size, 0) AS done FROM step{k} s LEFT JOIN had{k} h ON s.source IS NOT DISTINCT FROM h.source),
"""
    return rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
n AS (SELECT 1 + count(*) // {SALT_ROWS} AS salts FROM sized),
keyed AS (
  SELECT *, CASE WHEN size > 0 THEN length(bin(size)) * 8 + (size * 8) // (1::BIGINT << (length(bin(size)) - 1)) - 8 ELSE 0 END AS class,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % (SELECT salts FROM n) AS salt
  FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [{listed}][(row_number() OVER (ORDER BY source IS NULL, source COLLATE "binary") - 1) % {len(weights)} + 1] AS weight
  FROM sized GROUP BY source),
rounds AS (
  SELECT 0 AS i, 0::HUGEINT AS cs, 0::HUGEINT AS cw
  UNION ALL
  SELECT i + 1, (SELECT coalesce(sum(source_size), 0) FROM sources WHERE weight * (t - {most} * cs) >= source_size * {most} * (w - cw)),
         (SELECT coalesce(sum(weight), 0) FROM sources WHERE weight * (t - {most} * cs) >= source_size * {most} * (w - cw))
  FROM rounds, (SELECT sum(source_size) AS t, sum(weight) AS w FROM sources) WHERE i < (SELECT count(*) FROM sources) + 1),
last AS (SELECT cs, cw, t, w FROM rounds, (SELECT sum(source_size) AS t, sum(weight) AS w FROM sources) ORDER BY i DESC LIMIT 1),
aimed AS (
  SELECT source, source_size, CASE WHEN w - cw <= 0 OR weight * (t - {most} * cs) >= source_size * {most} * (w - cw) THEN ({most} * source_size)::DOUBLE
         ELSE (weight * (t - {most} * cs))::DOUBLE / (w - cw)::DOUBLE END AS target,
         ('0x' || substr(md5('{SEED}|' || coalesce(source, '') || CASE WHEN source IS NULL THEN '|null' ELSE '|' END), 1, 8))::BIGINT / {float(1 << 32)}::DOUBLE AS jitter
  FROM sources, last),
classed AS (
  SELECT k.doc_id, k.size, k.class, k.salt, a.source_size, a.target, a.source, a.jitter, {" + ".join(f"(max(k.size) OVER (PARTITION BY k.source, k.class) <= {x}::DOUBLE * a.target)::INT" for x in LARGE)} AS stratum
  FROM keyed k JOIN aimed a ON k.source IS NOT DISTINCT FROM a.source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source, stratum ORDER BY class, salt, size, doc_id) AS rank FROM classed),
rated0 AS (SELECT source, target, source_size, 0::BIGINT AS had, 0::BIGINT AS done FROM aimed),
{strata}
rates AS ({" UNION ALL ".join(f"SELECT source, {k} AS stratum, rate FROM step{k}" for k in range(len(LARGE) + 1))})
SELECT r.doc_id, r.size, r.source_size, r.target, {steps} * r.size AS taken FROM ranked r JOIN rates t ON r.source IS NOT DISTINCT FROM t.source AND r.stratum = t.stratum
"""
