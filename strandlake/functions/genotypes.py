"""Column functions over alleles, likelihoods and posteriors. IDs are those of the operator inventory."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values, which results must share with other programs: the largest phred-scaled likelihood that is stored, the sign of a
# missing allele, the limits of a switching probability, the scale and entropy of phase qualities, the steps of calibration bins.
PL_CAP = 255
MISSING = -1
LEAST_SWITCH = 1e-7
PHASE_SCALE, PHASE_ENTROPY = 99.0, 0.7
CALIBRATION_STEPS = 99.0


def d(x: float) -> Column:
    return F.lit(float(x))


# sites ----------------------------------------------------------------------------------------------


def cref(ac: Column, an: Column) -> Column:
    """FN-01: reference allele count; the alternative count is ac itself."""
    return an - ac


def minor_count(c0: Column, c1: Column) -> Column:
    """FN-05."""
    return F.least(c0, c1)


def maf(c0: Column, c1: Column) -> Column:
    """FN-02: minor allele frequency; null without alleles."""
    return F.try_divide(F.least(c0, c1).cast("double"), (c0 + c1).cast("double"))


def is_common(frequency: Column, sparse_maf: float) -> Column:
    """FN-03."""
    return F.coalesce(frequency >= d(sparse_maf), F.lit(False))


def major_allele(c0: Column, c1: Column) -> Column:
    """FN-04: 1 if the alternative is the more frequent."""
    return (c1 > c0).cast("int")


def is_monomorphic(c0: Column, c1: Column) -> Column:
    """FN-05, FLT-02."""
    return F.least(c0, c1) == 0


def is_singleton(c0: Column, c1: Column) -> Column:
    """FN-05."""
    return F.least(c0, c1) == 1


def site_key(pos: Column, ref: Column, alt: Column) -> Column:
    """FN-06."""
    return F.concat_ws("_", pos.cast("string"), ref, alt)


def variant_type(ref: Column, alt: Column) -> Column:
    """SNP, INDEL or OTHER by allele lengths."""
    return F.when((F.length(ref) == 1) & (F.length(alt) == 1), "SNP").when(F.length(ref) != F.length(alt), "INDEL").otherwise("OTHER")


# likelihoods ----------------------------------------------------------------------------------------


def unphred(q: Column) -> Column:
    """FN-07."""
    return F.pow(d(10.0), -q / d(10.0))


def decode_pl(pl: Column) -> Column:
    """SRC-14: null if any entry is missing, an error for negative entries, capped."""
    bad = F.exists(pl, lambda x: x < 0)
    return F.when(pl.isNull() | F.exists(pl, lambda x: x.isNull()), None).when(bad, F.raise_error(F.lit("negative PL"))).otherwise(F.transform(pl, lambda x: F.least(x, F.lit(PL_CAP)).cast("int")))


def decode_gl(gl: Column) -> Column:
    """SRC-15: log10 likelihoods to PL; an error for positive entries."""
    bad = F.exists(gl, lambda x: x > 0)
    return F.when(gl.isNull() | F.exists(gl, lambda x: x.isNull()), None).when(bad, F.raise_error(F.lit("positive GL"))).otherwise(F.transform(gl, lambda x: F.least(F.round(x * d(-10.0)), d(PL_CAP)).cast("int")))


def pl_to_gp(pl: Column) -> Column:
    """FN-08: likelihoods to normalised genotype probabilities."""
    p = F.transform(pl, lambda x: unphred(x.cast("double")))
    return F.transform(p, lambda x: x / F.aggregate(p, d(0.0), lambda a, b: a + b))


def hap_likelihoods(gp: Column, min_gl: float = 1e-10) -> Column:
    """FN-09, FN-11: genotype probabilities to the likelihoods of one haplotype's alleles, clamped."""
    h = F.when(F.size(gp) == 3, F.array(gp[0] + gp[1] / 2, gp[1] / 2 + gp[2])).otherwise(F.array(gp[0], gp[1]))
    return clamp(h, min_gl)


def conditional_likelihoods(gp: Column, other: Column, min_gl: float = 1e-10) -> Column:
    """FN-10, FN-11: likelihoods of one haplotype given the other's allele (diploid)."""
    a, b = F.element_at(gp, other + 1), F.element_at(gp, other + 2)
    return clamp(F.array(a / (a + b), b / (a + b)), min_gl)


def clamp(h: Column, low: float) -> Column:
    return F.transform(h, lambda x: F.least(F.greatest(x, d(low)), d(1.0 - low)))


# posteriors -----------------------------------------------------------------------------------------


def gp_from_haps(hp0: Column, hp1: Column) -> Column:
    """FN-12: genotype probabilities from two haplotypes' posteriors."""
    p = F.array(hp0[0] * hp1[0], hp0[0] * hp1[1] + hp0[1] * hp1[0], hp0[1] * hp1[1])
    return F.transform(p, lambda x: x / (p[0] + p[1] + p[2]))


def het_order(hp0: Column, hp1: Column) -> Column:
    """FN-13: whether the alternative allele of a heterozygote sits on the second haplotype."""
    return hp0[1] < hp1[1]


def third(gp0: Column, gp1: Column) -> Column:
    """FN-15."""
    return F.least(F.greatest(d(1.0) - gp1 - gp0, d(0.0)), d(1.0))


def best_genotype(gp0: Column, gp1: Column, gp2: Column) -> Column:
    """FN-14: strict maximum; 0 for ties."""
    return F.when((gp0 > gp1) & (gp0 > gp2), 0).when((gp1 > gp0) & (gp1 > gp2), 1).when((gp2 > gp0) & (gp2 > gp1), 2).otherwise(0)


def best_haploid(gp0: Column, gp1: Column) -> Column:
    return (gp1 > gp0).cast("int")


def dosage(gp: Column) -> Column:
    """FN-16: expected alternative alleles, to 3 places."""
    return F.round(F.when(F.size(gp) == 3, gp[1] + 2 * gp[2]).otherwise(gp[1]), 3)


def round_gp(gp: Column, n: int = 3) -> Column:
    """FN-17: n probabilities to thousandths that still add up, the largest remainders first, ties by genotype.

    Remainders are compared to 1e-9, in whole numbers, so that engines agree. Written out entry by entry: functions over arrays
    call their lambdas row by row outside of generated code.
    """
    nano = [F.round(F.get(gp, F.lit(k)) * d(1e9)).cast("long") for k in range(n)]
    milli = [F.call_function("div", x, F.lit(1_000_000).cast("long")) for x in nano]
    rest = [x % 1_000_000 for x in nano]
    lack = F.lit(1000) - sum(milli[1:], milli[0])

    def above(k: int) -> Column:
        return sum((F.when(rest[j] >= rest[k] if j < k else rest[j] > rest[k], 1).otherwise(0) for j in range(n) if j != k), F.lit(0))

    return F.when(gp.isNotNull(), F.array(*((milli[k] + F.when(above(k) < lack, 1).otherwise(0)) / d(1000.0) for k in range(n))))


def info_score(n_haps: Column, sum_ds: Column, sum_var: Column) -> Column:
    """FN-19: 1 - sum of posterior variances / (haplotypes * AF * (1 - AF)), within 0 and 1, to 3 places."""
    af = sum_ds / n_haps
    inside = (af > 0) & (af < 1)
    return F.when(inside, F.round(F.greatest(d(1.0) - sum_var / F.when(inside, n_haps * af * (d(1.0) - af)).otherwise(d(1.0)), d(0.0)), 3)).otherwise(d(1.0))


def posterior_variance(gp: Column, ds: Column) -> Column:
    """E[g^2] - DS^2."""
    return gp[1] + 4 * gp[2] - ds * ds


# evaluation -----------------------------------------------------------------------------------------


def frequency_bin(x: Column, edges: list[float]) -> Column:
    """FN-20: bins (low, high], counted from 0; -1 outside and for the lowest edge."""
    out = F.lit(-1)
    for i in range(len(edges) - 1, 0, -1):
        out = F.when((x > d(edges[i - 1])) & (x <= d(edges[i])), i - 1).otherwise(out)
    return out


def calibration_bin(gp0: Column, gp1: Column, gp2: Column) -> Column:
    """FN-21."""
    return F.floor(F.greatest(gp0, gp1, gp2) * d(CALIBRATION_STEPS)).cast("int")


def allele_frequency(tag: Column, ac: Column, an: Column) -> Column:
    """FN-22: the tag, else AC / AN."""
    return F.coalesce(tag, F.try_divide(ac.cast("double"), an.cast("double")))


def flips(af: Column, use_alt_af: bool = False) -> Column:
    """FN-23: whether alleles change places, so that frequencies are minor ones."""
    return F.lit(False) if use_alt_af else af > d(0.5)


def flip_gp(gp: Column, flip: Column) -> Column:
    return F.when(flip, F.reverse(gp)).otherwise(gp)


def flip_count(x: Column, ploidy: int, flip: Column) -> Column:
    """FN-23 for dosages and genotypes."""
    return F.when(flip, F.lit(ploidy) - x).otherwise(x)


def count_edges(an: int, ploidy: int = 2) -> list[float]:
    """FN-24: bin edges halfway between allele counts, the last at 0.5."""
    edges = [0.0] + [ac / an + 0.5 / an for ac in range(0, an // ploidy + 1) if ac / an + 0.5 / an < 0.5]
    last = 0.5 + 1e-9
    return [*edges, last] if last - edges[-1] >= 0.1 else [*edges[:-1], last]


def squared_correlation(n: Column, cov: Column, vx: Column, vy: Column) -> Column:
    """FN-25, AGG-02: 0 where either side is constant, null below two values."""
    return F.when(n < 2, None).when((vx == 0) | (vy == 0), d(0.0)).otherwise(cov * cov / F.when((vx == 0) | (vy == 0), d(1.0)).otherwise(vx * vy))


def standard_error_95(r2: Column, n: Column, k: int = 2) -> Column:
    """FN-26: large-sample 95 % bound of an R squared with k predictors."""
    squared = 4 * r2 * F.pow(1 - r2, 2) * F.pow(n - k - 1, 2) / ((n * n - 1) * (n + 3))
    return d(1.96) * F.sqrt(squared)


def discordance(errors: Column, correct_nonref: Column) -> Column:
    """FN-27: percent of errors among errors and right non-reference calls; 0 without any."""
    return F.coalesce(F.try_divide(d(100.0) * errors, (errors + correct_nonref).cast("double")), d(0.0))


def error_rate(errors: Column, total: Column) -> Column:
    """FN-28: percent; 0 without any."""
    return F.coalesce(F.try_divide(d(100.0) * errors, total.cast("double")), d(0.0))


def poisson(n: Column, mean: Column) -> Column:
    """FN-29: probability of n events; by logarithms where n! isn't a long (n above 20)."""
    n = n.cast("int")
    logs = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), d(0.0), lambda s, k: s + F.ln(k.cast("double")))
    far = F.when(mean > 0, F.exp(n * F.ln(mean) - mean - logs)).otherwise(0.0)
    return F.when(n <= 20, F.pow(mean, n) * F.exp(-mean) / F.factorial(F.least(n, F.lit(20))).cast("double")).otherwise(far)


def transition(cm: Column, n_ref: int, ne: float = 100_000.0, with_states: bool = False) -> Column:
    """FN-30: probability of switching state over a distance in centimorgans, clamped."""
    rate = 0.04 * ne / (max(n_ref, ne) if with_states else n_ref)
    return F.least(F.greatest(-F.expm1(cm * d(-rate)), d(LEAST_SWITCH)), d(1.0 - LEAST_SWITCH))


def emission(hl0: Column, hl1: Column, error: float) -> Column:
    """FN-31: likelihoods of the two alleles mixed with the copying error, normalised."""
    a, b = hl0 * d(1 - error) + hl1 * d(error), hl0 * d(error) + hl1 * d(1 - error)
    return F.array(a / (a + b), b / (a + b))


def phase_quality(match: Column, mismatch: Column) -> Column:
    """FN-32: 99 where either count is 0."""
    f = match / F.when(match + mismatch > 0, match + mismatch).otherwise(1)
    safe = F.when((match > 0) & (mismatch > 0), f).otherwise(d(0.5))
    q = d(PHASE_SCALE) * (d(PHASE_ENTROPY) + safe * F.ln(safe) + (1 - safe) * F.ln(1 - safe)) / d(PHASE_ENTROPY)
    return F.when((match == 0) | (mismatch == 0), d(PHASE_SCALE)).otherwise(q)


def error_logs(q: Column) -> Column:
    """FN-33: log10 of 1 - e, e / 3, 1/2 - e / 3 and e, for base qualities of 4 and more."""
    e = unphred(F.greatest(q, F.lit(4)).cast("double"))
    return F.array(F.log10(1 - e), F.log10(e / 3), F.log10(d(0.5) - e / 3), F.log10(e))


# truth and estimates ----------------------------------------------------------------------------------


def one_hot(gt: Column, ploidy: int = 2) -> Column:
    """FN-40: a hard genotype as probabilities; null for a missing one."""
    return F.when(gt.isNull() | (gt < 0), None).otherwise(F.array(*(F.when(gt == k, d(1.0)).otherwise(d(0.0)) for k in range(ploidy + 1))))


def truth_probabilities(gt: Column | None, pl: Column | None) -> Column:
    """FN-40: from hard genotypes if given, else from PL; a triple of -1 where missing or negative."""
    none = F.array(d(-1.0), d(-1.0), d(-1.0))
    if gt is not None:
        return F.coalesce(one_hot(gt), none)
    bad = pl.isNull() | F.exists(pl, lambda x: x.isNull() | (x < 0))
    return F.when(bad, none).otherwise(F.transform(pl, lambda x: unphred(x.cast("double"))))


def estimate(gp: Column | None, ds: Column | None, gt: Column | None = None, pl: Column | None = None) -> tuple[Column, Column]:
    """FN-41: probabilities and dosage: as given, from hard genotypes, or from PL."""
    if gt is not None:
        return one_hot(gt), gt.cast("double")
    if pl is not None:
        p = pl_to_gp(pl)
        return p, p[1] + 2 * p[2]
    return gp, ds


def truth_code(gp: Column, dp: Column, min_dp: int, min_p: float) -> Column:
    """FLT-10: the true genotype, or why it can't be used: -5 no depth, -2 low depth, -3 no likelihood, -4 too uncertain, -1 no single best."""
    total = gp[0] + gp[1] + gp[2]
    p = [gp[k] / F.when(total > 0, total).otherwise(d(1.0)) for k in range(3)]
    best = F.when((p[0] > p[1]) & (p[0] > p[2]), 0).when((p[1] > p[0]) & (p[1] > p[2]), 1).when((p[2] > p[0]) & (p[2] > p[1]), 2).otherwise(-1)
    return F.when(dp.isNull(), -5).when(dp < min_dp, -2).when((gp[0] < 0) | (gp[1] < 0) | (gp[2] < 0), -3).when(F.greatest(*p) < d(min_p), -4).otherwise(best)


def truth_code_haploid(gp: Column, dp: Column, min_dp: int, min_p: float) -> Column:
    """FLT-10 for haploids: 0 or 1, or why it can't be used, as truth_code."""
    total = gp[0] + gp[1]
    p = [gp[k] / F.when(total > 0, total).otherwise(d(1.0)) for k in range(2)]
    best = F.when(p[0] > p[1], 0).when(p[1] > p[0], 1).otherwise(-1)
    return F.when(dp.isNull(), -5).when(dp < min_dp, -2).when((gp[0] < 0) | (gp[1] < 0), -3).when(F.greatest(*p) < d(min_p), -4).otherwise(best)


def _outside(p: list[Column]) -> Column:
    """Whether one of some probabilities isn't one."""
    found = F.lit(False)
    for x in p:
        found = found | (x < 0) | (x > d(1.0 + 1e-7))
    return found


def estimate_code(gp: Column, min_gp: float) -> Column:
    """FLT-11: the best-guess genotype, or -3 for values outside 0 to 1, -4 below the filter."""
    p = [gp[k] for k in range(3)]
    return F.when(_outside(p), -3).when(F.greatest(*p) < d(min_gp), -4).otherwise(best_genotype(*p))


def estimate_code_haploid(gp: Column, min_gp: float) -> Column:
    """FLT-11 for haploids: a tie is no call (-1)."""
    p = [gp[k] for k in range(2)]
    return F.when(_outside(p), -3).when(F.greatest(*p) < d(min_gp), -4).when(p[0] == p[1], -1).otherwise((p[1] > p[0]).cast("int"))


def swap_phase(gt: Column, phased: Column, swap: Column) -> Column:
    """FN-39: alleles of a phased diploid genotype change places; missing, haploid and unphased ones stay."""
    ok = swap & phased & (F.size(gt) == 2) & ~F.exists(gt, lambda x: x.isNull())
    return F.when(F.coalesce(ok, F.lit(False)), F.reverse(gt)).otherwise(gt)


# strings ----------------------------------------------------------------------------------------------


def tokens(text: Column, separators: str = " \t") -> Column:
    """FN-34: fields between runs of separators, without carriage returns."""
    clean = F.regexp_replace(F.regexp_replace(text, "\r", ""), f"^[{separators}]+|[{separators}]+$", "")
    return F.filter(F.split(clean, f"[{separators}]+"), lambda x: x != "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def without_extension(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)


def is_numeric(text: Column) -> Column:
    return text.try_cast("double").isNotNull()


def file_stem(path: Column) -> Column:
    """FN-43: default sample name."""
    return without_extension(base_name(path))


def argmax(values: Column) -> Column:
    """FN-35: place (from 0) of the first largest value."""
    return F.array_position(values, F.array_max(values)) - 1


#: Checksums are below this prime.
CHECKSUM = (1 << 61) - 1


def checksum(rows: list[Column]) -> Column:
    """FN-36: order-independent checksum of rows as a multiset (an aggregate): the sum of their hashes, so that equal rows don't cancel. Null without rows."""
    return F.pmod(F.sum(F.xxhash64(*rows).cast("decimal(20,0)")), F.lit(CHECKSUM).cast("decimal(20,0)")).cast("long")
