"""Reads to genotype likelihoods: filters, the band join, base counts and coverage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import genotypes as G

# Bits of alignment flags.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, SECONDARY, QC_FAIL, DUPLICATE = 1, 2, 4, 8, 16, 32, 256, 512, 1024


@dataclass(frozen=True)
class ReadOptions:
    """FLT-17."""

    mapq: int = 10
    baseq: int = 10
    max_depth: int = 40
    keep_orphans: bool = False
    ignore_orientation: bool = False
    check_proper: bool = False
    keep_failed_qc: bool = False
    keep_duplicates: bool = False

    def __post_init__(self) -> None:
        if self.max_depth < 10:
            raise ValueError("max_depth must be 10 or more")
        if not (0 <= self.mapq <= 255 and 0 <= self.baseq <= 255):
            raise ValueError("qualities must be within 0 and 255")


def has(flag: int) -> Column:
    return F.col("flags").bitwiseAND(F.lit(flag)) != 0


def usable_reads(reads: DataFrame, o: ReadOptions = ReadOptions()) -> DataFrame:
    """FLT-07, FLT-08: mapped, primary, good reads in the expected orientation to their mates."""
    bad = has(UNMAPPED) | has(SECONDARY) | (F.col("mapq") < o.mapq)
    if not o.keep_failed_qc:
        bad |= has(QC_FAIL)
    if not o.keep_duplicates:
        bad |= has(DUPLICATE)
    pair = F.lit(False)
    if not o.keep_orphans:
        pair |= has(MATE_UNMAPPED)
    if o.check_proper:
        pair |= ~has(PROPER)
    if not o.ignore_orientation:
        away = F.coalesce(F.col("mate_chrom") != F.col("chrom"), F.lit(False)) if "mate_chrom" in reads.columns else F.lit(False)
        pair |= away | (has(REVERSE) & has(MATE_REVERSE)) | ((F.col("pos") < F.col("mate_pos")) & has(REVERSE)) | ((F.col("pos") > F.col("mate_pos")) & ~has(REVERSE))
    return reads.filter(~(bad | (has(PAIRED) & pair)))


#: Pieces of reads in a block from which on the block is dealt over several tasks, and blocks of that kind that are broadcast.
DEEP, BROADCAST = 100_000, 50_000


def deep_blocks(pieces: DataFrame, deep: int) -> DataFrame | None:
    """Blocks (block, chrom) with more pieces than that, with the number of parts to deal them over; None without any. Pieces are added up before the shuffle."""
    keys = [c for c in ("block", "chrom") if c in pieces.columns]
    found = pieces.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > deep).select(*keys, F.ceil(F.col("n") / deep).cast("int").alias("parts"))
    found = found.persist()
    n = found.count()
    return F.broadcast(found) if 0 < n <= BROADCAST else found if n else None


def joined(pieces: DataFrame, sites: DataFrame, deep: DataFrame | None) -> DataFrame:
    """Pieces (block, read_pos, len) with the sites within them. Deep blocks are dealt by reads; only their sites are repeated."""
    keys = [c for c in ("block", "chrom") if c in pieces.columns and c in sites.columns]
    if deep is not None:
        hashed = F.pmod(F.xxhash64("read_id", "read_pos"), F.coalesce("parts", F.lit(1))).cast("int")
        pieces = pieces.join(deep, keys, "left").withColumn("part", hashed).drop("parts")
        sites = sites.join(deep, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        keys = [*keys, "part"]
    return pieces.join(sites, keys).filter((F.col("pos") >= F.col("read_pos")) & (F.col("pos") < F.col("read_pos") + F.col("len"))).drop("block", "part")


def cover(reads: DataFrame, sites: DataFrame, width: int = 256, deep: int | None = None) -> DataFrame:
    """JOIN-10: pairs of a read and a site within it, by an equality join on blocks of positions.

    A read is repeated for each block it touches, so width should be near the read length. With `deep` (DEEP), reads of blocks
    are counted first, and those of deeper blocks are dealt over several tasks.
    """
    r = reads.withColumn("block", F.explode(F.sequence(F.expr(f"pos div {width}"), F.expr(f"(pos + len - 1) div {width}")))).withColumnRenamed("pos", "read_pos")
    return joined(r, sites.withColumn("block", F.expr(f"pos div {width}")), deep_blocks(r, deep) if deep else None)


# Stretches of a CIGAR in one pass: op, n, and bases of the reference (MDN=X) and of the read (MIS=X) before each; the last
# element holds the totals.
STRETCHES = """aggregate(parsed, array(named_struct('op', '', 'n', 0, 'ref_at', 0L, 'at', 0L)), (s, x) -> concat(
  slice(s, 1, size(s) - 1), array(
    named_struct('op', x.op, 'n', x.n, 'ref_at', element_at(s, -1).ref_at, 'at', element_at(s, -1).at),
    named_struct('op', '', 'n', 0, 'ref_at', element_at(s, -1).ref_at + if(x.op IN ('M', 'D', 'N', '=', 'X'), x.n, 0), 'at', element_at(s, -1).at + if(x.op IN ('M', 'I', 'S', '=', 'X'), x.n, 0)))))"""
# What a stretch shows behind its last base: bases inserted (positive) or deleted (negative).
INDEL = "CASE WHEN stretches[i].op NOT IN ('M', '=', 'X') THEN 0 WHEN get(stretches, i + 1).op = 'I' THEN get(stretches, i + 1).n WHEN get(stretches, i + 1).op = 'D' THEN -get(stretches, i + 1).n ELSE 0 END"
COVERING = "filter(if(size(stretches) > 1, sequence(0, size(stretches) - 2), array()), i -> stretches[i].op IN ('M', 'D', 'N', '=', 'X') AND stretches[i].n > 0)"


def _stretches(reads: DataFrame) -> DataFrame:
    parts = F.regexp_extract_all("cigar", F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    parsed = F.transform(parts, lambda p: F.struct(F.right(p, F.lit(1)).alias("op"), F.substr(p, F.lit(1), F.length(p) - 1).cast("int").alias("n")))
    return reads.withColumn("parsed", parsed).withColumn("stretches", F.expr(STRETCHES)).drop("parsed")


def segments(reads: DataFrame) -> DataFrame:
    """SRC-16: a row per stretch of a read's alignment (cigar) that covers reference positions: pos, len, op, at (0-based place in the read), indel.

    indel: bases inserted (positive) or deleted (negative) right behind the stretch, which belong to its last base. Other
    columns stay; a read without an alignment has no row.
    """
    each = f"transform({COVERING}, i -> named_struct('op', stretches[i].op, 'n', stretches[i].n, 'ref_at', stretches[i].ref_at, 'at', stretches[i].at, 'indel', {INDEL}))"
    x = _stretches(reads).withColumn("stretch", F.explode(F.expr(each)))
    columns = {"pos": F.col("pos") + F.col("stretch.ref_at"), "len": F.col("stretch.n"), "op": F.col("stretch.op"), "at": F.col("stretch.at"), "indel": F.col("stretch.indel")}
    return x.withColumns(columns).drop("stretches", "stretch")


def pieces(reads: DataFrame, width: int, ahead: int) -> DataFrame:
    """A row per stretch and block of positions: block, read_pos, len, op, at, indel, room (bases from there to the read's end), and the bases and
    quals of the piece with `ahead` more, instead of the read's (null where the read has none). Strings are cut before they are shuffled."""
    first, last = f"(pos + stretches[i].ref_at) div {width}", f"(pos + stretches[i].ref_at + stretches[i].n - 1) div {width}"
    piece = f"named_struct('b', b, 'start', pos + stretches[i].ref_at, 'n', stretches[i].n, 'op', stretches[i].op, 'at', stretches[i].at, 'indel', {INDEL})"
    each = F.expr(f"flatten(transform({COVERING}, i -> transform(sequence({first}, {last}), b -> {piece})))")
    others = [c for c in reads.columns if c not in ("pos", "len", "cigar", "bases", "quals")]
    x = _stretches(reads).select(*others, "bases", "quals", F.explode(each).alias("p"))
    x = x.select(*others, "bases", "quals", F.col("p.b").alias("block"), F.col("p.start").alias("start_"), (F.col("p.start") + F.col("p.n")).alias("stop_"), F.col("p.op").alias("op"), F.col("p.at").alias("at"), F.col("p.indel").alias("indel"))
    low, high = F.greatest(F.col("start_"), F.col("block") * width), F.least(F.col("stop_"), (F.col("block") + 1) * width)
    x = x.withColumns({"read_pos": low, "len": (high - low).cast("int"), "at": F.col("at") + low - F.col("start_"), "indel": F.when(high == F.col("stop_"), F.col("indel")).otherwise(0)})
    cut = {c: F.when(F.col("op").isin("M", "=", "X") & (F.col(c) != "*"), F.substr(F.col(c), (F.col("at") + 1).cast("int"), F.col("len") + ahead)) for c in ("bases", "quals")}
    return x.withColumn("room", (F.length("bases") - F.col("at")).cast("int")).withColumns(cut).select(*others, "block", "read_pos", "len", "op", "at", "indel", "room", "bases", "quals")


def bases_at(pile: DataFrame) -> DataFrame:
    """JOIN-10, FLT-09: offset (in the read), base, qual and read_indel of pieces of reads at sites; null bases for deleted and skipped positions.

    `within` is the place in the piece's own strings, `left` how many bases the read has from there on.
    """
    aligned = F.col("op").isin("M", "=", "X")
    within = F.when(aligned, F.col("pos") - F.col("read_pos")).cast("int")
    x = pile.withColumns({"within": within, "offset": F.when(aligned, F.col("at") + F.col("pos") - F.col("read_pos")).cast("int"), "left": F.col("room") - within})
    qual = F.when(F.col("quals").isNull(), 255).otherwise(F.ascii(F.substr("quals", F.col("within") + 1, F.lit(1))) - 33)
    last = F.col("pos") == F.col("read_pos") + F.col("len") - 1
    return x.withColumns({"base": F.upper(F.substr("bases", F.col("within") + 1, F.lit(1))), "qual": F.when(aligned, qual), "read_indel": F.when(aligned, F.when(last, F.col("indel")).otherwise(0))})


def pile_up(reads: DataFrame, sites: DataFrame, width: int = 256, deep: int | None = None) -> DataFrame:
    """SRC-16, JOIN-10: reads (with cigar, bases, quals) at sites, by base. Only as much of a read's strings travels as a block's sites need."""
    longest = sites.agg(F.max(F.greatest(F.length("ref"), F.length("alt"))).alias("n")).first()["n"] or 1
    r = pieces(reads, width, longest - 1)
    return bases_at(joined(r, sites.withColumn("block", F.expr(f"pos div {width}")), deep_blocks(r, deep) if deep else None))


def usable_bases(pile: DataFrame, o: ReadOptions = ReadOptions()) -> DataFrame:
    """FLT-09: A, C, G or T of sufficient quality; deleted and skipped positions have none."""
    return pile.filter(F.col("base").isin("A", "C", "G", "T") & (F.col("qual") >= o.baseq))


def limit_depth(pile: DataFrame, o: ReadOptions = ReadOptions(), seed: int = 20011) -> DataFrame:
    """SMP-02: at most max_depth reads a sample and site, drawn by a hash of the read."""
    draw = F.md5(F.concat_ws("|", F.lit(seed), "sample", "site", "read_id").cast("binary"))
    w = Window.partitionBy("sample", "site").orderBy(draw, "read_id")
    return pile.withColumn("draw", F.row_number().over(w)).filter(F.col("draw") <= o.max_depth).drop("draw")


def likelihoods(pile: DataFrame, ploidy: int = 2) -> DataFrame:
    """MDL-01, MDL-02, MDL-04, FN-33: log10 likelihoods of the genotypes from bases, as PL, and a flag for flat ones.

    A base that is the allele of a homozygote counts 1 - e, one of a heterozygote's alleles 1/2 - e/3,
    any other e/3. Sums of logs combine before the shuffle.
    """
    logs = G.error_logs(F.col("qual"))
    is_ref, is_alt = F.col("base") == F.col("ref"), F.col("base") == F.col("alt")
    if ploidy == 2:
        terms = [F.when(is_ref, logs[0]).otherwise(logs[1]), F.when(is_ref | is_alt, logs[2]).otherwise(logs[1]), F.when(is_alt, logs[0]).otherwise(logs[1])]
    else:
        terms = [F.when(is_ref, logs[0]).otherwise(logs[3]), F.when(is_alt, logs[0]).otherwise(logs[3])]
    names = [f"l{k}" for k in range(len(terms))]
    summed = pile.groupBy("sample", "site").agg(F.count("*").alias("depth"), *(F.sum(t).alias(n) for t, n in zip(terms, names, strict=True)))
    best = F.greatest(*names)
    pl = F.array(*(F.least(F.floor(F.round((best - F.col(n)) * 10.0, 6)), F.lit(G.PL_CAP)).cast("int") for n in names))
    return summed.withColumn("pl", pl).withColumn("flat", F.array_min("pl") == F.array_max("pl"))


def _mean_quality(n) -> Column:
    """Mean of n qualities from the site's base on, rounded down."""
    places = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.ascii(F.substr("quals", F.col("within") + k, F.lit(1))) - 33)
    return F.when(F.col("quals").isNull(), 255).otherwise(F.floor(F.aggregate(places, F.lit(0), lambda s, q: s + q) / F.greatest(n, F.lit(1)))).cast("int")


def indel_bases(pile: DataFrame, o: ReadOptions = ReadOptions()) -> DataFrame:
    """MDL-03: at insertions and deletions (one allele of one base), base becomes the allele that a read shows and qual a mean quality; other reads go.

    A read must have the anchor base. Insertion: without an indel it shows the reference; with one of the size of the
    alternative (less, where the read ends) and the same bases but the last, the alternative. Deletion: with one of its
    size, the alternative; without an indel and with the reference's bases as far as the read goes, the reference.
    """
    left = F.col("left")
    inserts, deletes = (F.length("ref") == 1) & (F.length("alt") > 1), (F.length("ref") > 1) & (F.length("alt") == 1)
    size = F.least(F.length("alt"), left) - 1
    same = F.substr("bases", F.col("within") + 2, size - 1) == F.substr("alt", F.lit(2), size - 1)
    shown = F.least(F.length("ref"), left)
    plain = F.substr("bases", F.col("within") + 1, shown) == F.substr("ref", F.lit(1), shown)
    indel = F.col("read_indel")
    supports = (
        F.when(inserts & (indel == 0), F.col("ref")).when(inserts & (indel > 0) & (indel == size) & same, F.col("alt"))
        .when(deletes & (indel == 0) & plain, F.col("ref")).when(deletes & (indel == 1 - F.length("ref")), F.col("alt"))
    )
    qual = F.when(inserts & (indel > 0), _mean_quality(indel)).when(deletes & (indel == 0), _mean_quality(shown)).otherwise(F.col("qual"))
    x = pile.filter(F.col("base") == F.substr("ref", F.lit(1), F.lit(1))).withColumns({"shows": supports, "mean_qual": qual})
    return x.filter(F.col("shows").isNotNull() & (F.col("mean_qual") >= o.baseq)).withColumns({"base": F.col("shows"), "qual": F.col("mean_qual")}).drop("shows", "mean_qual")


def usable_evidence(pile: DataFrame, o: ReadOptions = ReadOptions()) -> DataFrame:
    """FLT-09, MDL-03: usable bases at SNPs, indel evidence at insertions and deletions; likelihoods() takes both."""
    snp = (F.length("ref") == 1) & (F.length("alt") == 1)
    return usable_bases(pile.filter(snp), o).unionByName(indel_bases(pile.filter(~snp), o))


def snp_only(likelihoods: DataFrame, use_indels: bool = False) -> DataFrame:
    """FLT-05: likelihoods of sites that aren't SNPs count as uninformative unless asked for."""
    if use_indels:
        return likelihoods
    ignored = F.col("vtype") != "SNP"
    return likelihoods.withColumn("pl", F.when(ignored, F.transform("pl", lambda _: F.lit(0))).otherwise(F.col("pl"))).withColumn("flat", ignored | F.col("flat"))


def coverage(pile: DataFrame, sites: DataFrame, samples: DataFrame) -> DataFrame:
    """AGG-14, SNK-05, FN-29: depth classes (0 to 4, 5 to 10, 11 to 30, more) per sample over all sites, with those a Poisson law gives."""
    per = pile.groupBy("sample", "site").agg(F.count("*").alias("depth"))
    classes = [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 10), (11, 30), (31, 1 << 30)]
    counts = [F.sum(F.col("depth").between(a, b).cast("long")).alias(f"c{i}") for i, (a, b) in enumerate(classes)]
    observed = per.groupBy("sample").agg(F.sum("depth").alias("reads"), F.count("*").alias("covered"), *counts)
    n = sites.agg(F.count("*").alias("n_sites"))
    out = samples.join(observed, "sample", "left").crossJoin(F.broadcast(n)).na.fill(0)
    mean = F.col("reads") / F.col("n_sites")
    out = out.withColumn("mean_depth", mean).withColumn("no_data", 100.0 * (F.col("n_sites") - F.col("covered")) / F.col("n_sites"))
    out = out.withColumn("c0", F.col("n_sites") - F.col("covered"))
    each = [G.poisson(F.lit(i), F.col("mean_depth")) for i in range(31)]
    share = [*each[:5], sum(each[6:11], each[5]), sum(each[12:31], each[11])]
    share.append(F.greatest(F.lit(1.0) - sum(each[1:], each[0]), F.lit(0.0)))
    return out.withColumns({f"e{i}": F.col("n_sites") * p for i, p in enumerate(share)})
