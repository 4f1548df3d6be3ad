"""Imputation and phasing kernels (NumPy), and the plan that runs them per window and block of samples.

Target samples don't influence each other, so all iterations of a sample run in one task, beside the
window's panel: one shuffle in all. Random draws are keyed by seed, window and sample.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "chunk int, sample string, site int, gp0 double, gp1 double, gp2 double, ds double, h0 int, h1 int"


@dataclass(frozen=True)
class ModelOptions:
    """FLT-17: burn-in and main iterations, population size, error rates, states."""

    burnin: int = 5
    main: int = 15
    ne: float = 100_000.0
    min_gl: float = 1e-10
    err_imp: float = 1e-12
    err_phase: float = 1e-4
    k_init: int = 1000
    k_pbwt: int = 2000
    depth: int = 12
    modulo_cm: float = 0.1
    seed: int = 20011

    def __post_init__(self) -> None:
        if not 1 <= self.main <= 15:
            raise ValueError("main must be within 1 and 15")
        if self.burnin < 0 or self.depth < 1 or min(self.k_init, self.k_pbwt) < 1:
            raise ValueError("iterations and states must be positive")
        object.__setattr__(self, "err_imp", min(max(self.err_imp, 1e-12), 1e-3))


# PBWT -------------------------------------------------------------------------------------------------


def prefix_orders(panel: np.ndarray) -> np.ndarray:
    """MDL-06, SRT-01: after each site (row), the haplotypes ordered by their reversed prefixes: a stable partition by allele."""
    order = np.arange(panel.shape[1], dtype=np.int32)
    out = np.empty(panel.shape, dtype=np.int32)
    for l, row in enumerate(panel):
        ones = row[order] == 1
        order = np.concatenate([order[~ones], order[ones]])
        out[l] = order
    return out


def ones_before(panel: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """How many ones a site has before each place of the order that it meets (sites, haplotypes + 1); counted once for all targets of a panel."""
    out = np.zeros((panel.shape[0], panel.shape[1] + 1), dtype=np.int32)
    for l, row in enumerate(panel):
        np.cumsum(row[orders[l - 1]] if l else row, dtype=np.int32, out=out[l, 1:])
    return out


def matches(panel: np.ndarray, orders: np.ndarray, hap: np.ndarray, ones: np.ndarray | None = None) -> np.ndarray:
    """MDL-09: where a target haplotype would stand in each order; with `ones_before` at hand, one look a site whatever the panel's size."""
    ones = ones_before(panel, orders) if ones is None else ones
    at, n, out = 0, panel.shape[1], np.empty(len(hap), dtype=np.int64)
    for l, allele in enumerate(hap):
        before = int(ones[l, at])
        at = n - int(ones[l, n]) + before if allele else at - before
        out[l] = at
    return out


def select_states(panel: np.ndarray, orders: np.ndarray, hap: np.ndarray, chosen: np.ndarray, depth: int, most: int, ones: np.ndarray | None = None) -> np.ndarray:
    """TOP-01, TOP-02, MDL-09: neighbours in the orders at chosen sites, nearest first, later sites first, distinct, up to most."""
    l, ring = chosen[::-1], np.arange(1, depth + 1)[:, None]
    at, n = matches(panel, orders, hap, ones)[l], panel.shape[1]
    k = np.stack([at - ring, at + ring - 1], axis=2)  # rings, sites, sides: in order of preference
    sites = np.broadcast_to(l[None, :, None], k.shape)
    inside = (k >= 0) & (k < n)
    who = orders[sites, np.clip(k, 0, n - 1)]
    found, first = np.unique(who[inside & (panel[sites, who] == hap[sites])], return_index=True)
    return np.sort(found[np.argsort(first)[:most]]).astype(np.int64)


def initial_states(panel: np.ndarray, gp: np.ndarray, most: int, rng: np.random.Generator, count: np.ndarray | None = None) -> np.ndarray:
    """MDL-07, MDL-08: carriers of rare alleles the sample probably has (rarest first, five each, up to 80 %), the rest at random."""
    n = panel.shape[1]
    if n <= most:
        return np.arange(n)
    count = panel.sum(axis=1) if count is None else count
    minor = np.where(count * 2 <= n, 1, 0)
    mac = np.minimum(count, n - count)
    f = mac / n
    prior = np.stack([(1 - f) ** 2, 2 * f * (1 - f), f**2], axis=1)
    p = np.where(minor[:, None] == 1, gp, gp[:, ::-1]) * prior
    carries = p[:, 1:].sum(axis=1) > p[:, 0]
    found: dict[int, None] = {}
    for l in sorted(np.flatnonzero(carries & (mac > 0) & (f < 0.01)), key=lambda i: (mac[i], i)):
        who = np.flatnonzero(panel[l] == minor[l])
        for k in rng.permutation(who)[:5]:
            if len(found) < 0.8 * most:
                found.setdefault(int(k))
    for k in rng.permutation(n):
        if len(found) >= most:
            break
        found.setdefault(int(k))
    return np.array(sorted(found))


# hidden Markov models -----------------------------------------------------------------------------------


def transitions(cm: np.ndarray, n_ref: int, ne: float) -> np.ndarray:
    """FN-30 between neighbouring sites; the first is unused."""
    gap = np.diff(cm, prepend=cm[:1])
    return np.clip(-np.expm1(-0.04 * ne / max(n_ref, 1) * gap), 1e-7, 1 - 1e-7)


def impute(states: np.ndarray, hl: np.ndarray, flat: np.ndarray, lq: np.ndarray, t: np.ndarray, error: float) -> np.ndarray:
    """MDL-11: posteriors of a haplotype's alleles (sites, 2). states: alleles (sites, states); hl: likelihoods (sites, 2).

    Sites where all states agree need no model (FLT-16); flat and low-quality sites don't emit.
    """
    sites, k = states.shape
    out = np.empty((sites, 2))
    total = states.sum(axis=1)
    poly = np.flatnonzero((total > 0) & (total < k))
    mono = np.setdiff1d(np.arange(sites), poly)
    out[mono] = np.where((total[mono] > 0)[:, None], [error, 1 - error], [1 - error, error])
    if len(poly):
        x = states[poly]
        mixed = hl[poly] * (1 - error) + hl[poly][:, ::-1] * error
        mixed /= mixed.sum(axis=1, keepdims=True)
        informative = ~(flat[poly] | lq[poly])
        # switching over skipped sites: complements multiply
        stay = np.concatenate([[0.0], np.cumsum(np.log1p(-t))])
        jump = -np.expm1(stay[poly[1:] + 1] - stay[poly[:-1] + 1])
        alpha = np.empty((len(poly), k))
        for l in range(len(poly)):
            a = np.full(k, 1.0 / k) if l == 0 else alpha[l - 1] * ((1 - jump[l - 1]) / alpha[l - 1].sum()) + jump[l - 1] / k
            alpha[l] = a * mixed[l][x[l]] if informative[l] else a
        beta = np.full(k, 1.0 / k)
        for l in range(len(poly) - 1, -1, -1):
            w = alpha[l] * beta
            h1 = float(w[x[l] == 1].sum())
            h = np.array([float(w.sum()) - h1, h1])
            if informative[l]:
                h = h / mixed[l]
            out[poly[l]] = [h[0] * (1 - error) + h[1] * error, h[0] * error + h[1] * (1 - error)]
            if l:
                b = beta * mixed[l][x[l]] if informative[l] else beta
                beta = b * ((1 - jump[l - 1]) / b.sum()) + jump[l - 1] / k
    out *= np.where(flat[:, None], 1.0, hl)
    return out / out.sum(axis=1, keepdims=True)


def segments(het: np.ndarray, most: int = 3) -> np.ndarray:
    """WIN-17: number of the segment of each site; a new one opens where a fourth heterozygote would enter."""
    out, seg, n = np.empty(len(het), dtype=np.int64), 0, 0
    for l, h in enumerate(het):
        if h:
            if n == most:
                seg, n = seg + 1, 0
            n += 1
        out[l] = seg
    return out


def junctions(states: np.ndarray, seg: np.ndarray, alleles: np.ndarray, t: np.ndarray, error: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """MDL-12: for neighbouring segments, how likely each pair of their haplotypes is with all data (8, 8); for each segment, each haplotype (8).

    Forward and backward passes over the states run for the eight haplotypes of a segment at once; from and to other segments,
    their haplotypes are equally likely. Values of one array are relative to each other.
    """
    k, n = states.shape[1], int(seg[-1]) + 1
    own = [np.flatnonzero(seg == s) for s in range(n)]

    emits = np.stack([np.where(states == a, 1 - error, error) for a in (0, 1)], axis=1)  # by site and allele
    same = (alleles == alleles[:, :1]).all(axis=1)  # no heterozygote: one row for all eight

    def emit(l: int) -> np.ndarray:
        return emits[l, alleles[l, :1] if same[l] else alleles[l]]

    def step(v: np.ndarray, l: int) -> np.ndarray:
        """Over the gap before site l; the same from either side."""
        return v * (1 - t[l]) + t[l] * v.mean(axis=-1, keepdims=True)

    ends, v = [], np.full((8, k), 1.0 / k)
    for places in own:  # the data up to a segment's last site, and the state there
        for l in places:
            v = (step(v, l) if l else v) * emit(l)
            v /= v.max()
        ends.append(v)
        v = np.repeat(v.mean(axis=0)[None], 8, axis=0)
    pairs: list[np.ndarray] = []
    alone: list[np.ndarray] = []
    future = np.ones(k)
    for s in range(n - 1, -1, -1):
        alone.append(ends[s] @ future)
        b = np.repeat(future[None], 8, axis=0)
        for l in own[s][::-1]:  # the data from a segment's first site on, given the state there
            b = b * emit(l)
            if l != own[s][0]:
                b = step(b, l)
            b /= b.max()
        if s:
            pairs.append(step(ends[s - 1], own[s][0]) @ b.T)
            future = step(b.mean(axis=0), own[s][0])
    return pairs[::-1], alone[::-1]


def phase(states: np.ndarray, h0: np.ndarray, h1: np.ndarray, t: np.ndarray, error: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """MDL-12: heterozygotes drawn anew: eight haplotypes a segment, each with its complement, joined from segment to segment in such pairs.

    A backward pass sums what follows over the complementary pairs of the next segment, then pairs are drawn forward. With up to
    two segments that is a draw from all phasings by the product of their haplotypes' likelihoods; with more, segments two apart
    are independent given the one between.
    """
    het = h0 != h1
    if het.sum() < 2:
        return h0, h1
    seg = segments(het)
    n = int(seg[-1]) + 1
    hets = [np.flatnonzero(het & (seg == s)) for s in range(n)]
    alleles = np.repeat(h0[:, None], 8, axis=1)
    for places in hets:
        for bit, l in enumerate(places):
            alleles[l] = (np.arange(8) >> bit) & 1
    pairs, alone = junctions(states, seg, alleles, t, error)
    first = [np.arange(1 << len(places)) for places in hets]  # one haplotype of each pair, in both orders
    other = [x[::-1] for x in first]

    def joined(s: int) -> np.ndarray:
        """Weights of a pair of segment s with one of segment s + 1."""
        w = pairs[s][np.ix_(first[s], first[s + 1])] * pairs[s][np.ix_(other[s], other[s + 1])]
        return w / w.max()

    follows = [np.ones(len(first[-1]))]
    for s in range(n - 2, -1, -1):
        inner = alone[s + 1][first[s + 1]] * alone[s + 1][other[s + 1]] if s + 1 < n - 1 else 1.0
        ahead = joined(s) @ (follows[-1] / inner)
        follows.append(ahead / ahead.max())
    follows = follows[::-1]
    n0, n1 = h0.copy(), h1.copy()
    for s in range(n):
        if n == 1:
            w = alone[0][first[0]] * alone[0][other[0]]
        elif s == 0:
            w = follows[0]
        else:
            inner = alone[s][first[s]] * alone[s][other[s]] if s < n - 1 else 1.0
            w = joined(s - 1)[d] * follows[s] / inner
        d = min(categorical(w, rng), len(w) - 1)
        for bit, l in enumerate(hets[s]):
            n0[l], n1[l] = (d >> bit) & 1, 1 - ((d >> bit) & 1)
    return n0, n1


def sample_hap(hp: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """SMP-05: an allele a site by its posterior."""
    return (rng.random(len(hp)) < hp[:, 1]).astype(np.int64)


def categorical(weights: np.ndarray, rng: np.random.Generator) -> int:
    """SMP-04."""
    return int(np.searchsorted(np.cumsum(weights), rng.random() * np.sum(weights), side="right"))


def generator(seed: int, *keys: object) -> np.random.Generator:
    """Draws that depend on the keys alone, not on partitions."""
    return np.random.Generator(np.random.Philox(key=[seed, zlib.crc32("|".join(map(str, keys)).encode())]))


def gibbs(panel: np.ndarray, cm: np.ndarray, gp: np.ndarray, flat: np.ndarray, lq: np.ndarray, o: ModelOptions, *keys: object, orders: np.ndarray | None = None, ones: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """MDL-10, MDL-13, MDL-14, MDL-15: one initial, burn-in and main iterations of one sample; mean posteriors and phased haplotypes.

    The panel's orders and `ones_before` are made once for all samples: no step of an iteration goes over all haplotypes then.
    """
    sites, n = panel.shape
    rng = generator(o.seed, *keys)
    site_rng = generator(o.seed, keys[0] if keys else 0, "sites")  # the same sites for all samples of a window
    t = transitions(cm, n, o.ne)
    group = np.round(cm / o.modulo_cm).astype(np.int64)
    h = np.zeros((2, sites), dtype=np.int64)
    p = np.clip(np.stack([gp[:, 0] + gp[:, 1] / 2, gp[:, 1] / 2 + gp[:, 2]], axis=1), o.min_gl, 1 - o.min_gl)
    full = n <= o.k_pbwt
    if not full and orders is None:
        orders = prefix_orders(panel)
    if not full and ones is None:
        ones = ones_before(panel, orders)
    total, states = np.zeros((sites, 3)), initial_states(panel, gp, o.k_init, rng, None if full else ones[:, n].astype(np.int64))
    for turn in range(1 + o.burnin + o.main):
        if full:
            states = np.arange(n)
        elif turn:
            _, first = np.unique(group, return_index=True)
            size = np.diff(np.append(first, sites))
            chosen = first + np.floor(site_rng.random(len(first)) * size).astype(np.int64)  # SMP-03
            states = np.union1d(*(select_states(panel, orders, x, chosen, o.depth, o.k_pbwt // 2, ones) for x in h))  # SET-01
        x = panel[:, states]
        hp = []
        for side in (0, 1):
            if turn or side:
                other = h[1 - side]
                rows = np.arange(sites)
                c = np.stack([gp[rows, other], gp[rows, other + 1]], axis=1)
                like = np.clip(c / np.maximum(c.sum(axis=1, keepdims=True), 1e-300), o.min_gl, 1 - o.min_gl)
            else:
                like = p
            hp.append(impute(x, like, flat, lq, t, o.err_imp))
            h[side] = sample_hap(hp[side], rng)
        h[0], h[1] = phase(x, h[0], h[1], t, o.err_phase, rng)
        if turn > o.burnin:
            a, b = hp
            q = np.stack([a[:, 0] * b[:, 0], a[:, 0] * b[:, 1] + a[:, 1] * b[:, 0], a[:, 1] * b[:, 1]], axis=1)
            total += q / q.sum(axis=1, keepdims=True)
    return total / o.main, h[0], h[1]


# plan ---------------------------------------------------------------------------------------------------


def pack(panel: DataFrame) -> DataFrame:
    """SNK-02, BIT-01: (chunk, site, allele, hap) to a row of bits a site; haplotypes in order."""
    def bits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hap")
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "site": [pdf["site"].iloc[0]], "n_haps": [len(pdf)], "bits": [np.packbits(pdf["allele"].to_numpy().astype(np.uint8)).tobytes()]})

    return panel.groupBy("chunk", "site").applyInPandas(bits, "chunk int, site int, n_haps int, bits binary")


def run(packed: DataFrame, targets: DataFrame, options: ModelOptions = ModelOptions(), block: int = 64) -> DataFrame:
    """Impute and phase. packed: chunk, site, n_haps, bits, cm, lq; targets: chunk, sample, site, gp0..gp2, flat.

    Samples are dealt to blocks of about `block`, smaller ones only as far as tasks would be idle; a window's panel goes to each of its blocks.
    """
    samples, tasks = targets.select("chunk", "sample").distinct(), 4 * int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = F.greatest(F.ceil(F.count("*") / block), F.least(F.ceil(F.count("*") / 4), F.lit(tasks)))
    per = samples.groupBy("chunk").agg(blocks.cast("long").alias("blocks"))
    placed = targets.join(per, "chunk").withColumn("block", F.pmod(F.crc32(F.col("sample").cast("string").cast("binary")), "blocks")).drop("blocks")
    panels = packed.join(per, "chunk").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")

    def work(panel: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        columns = [f.split()[0] for f in SCHEMA.split(", ")]
        if panel.empty or cells.empty:
            return pd.DataFrame(columns=columns)
        panel = panel.sort_values("site")
        n = int(panel["n_haps"].iloc[0])
        x = np.unpackbits(np.stack([np.frombuffer(b, dtype=np.uint8) for b in panel["bits"]]), axis=1)[:, :n]
        sites, chunk = panel["site"].to_numpy(), int(panel["chunk"].iloc[0])
        orders = prefix_orders(x) if n > options.k_pbwt else None
        ones = None if orders is None else ones_before(x, orders)
        out = []
        for sample, own in cells.groupby("sample", sort=True):
            own = own.set_index("site").reindex(sites)
            gp = own[["gp0", "gp1", "gp2"]].fillna(1 / 3).to_numpy()
            flat = own["flat"].fillna(True).astype(bool).to_numpy()
            g, a, b = gibbs(x, panel["cm"].to_numpy(), gp, flat, panel["lq"].to_numpy().astype(bool), options, chunk, sample, orders=orders, ones=ones)
            out.append(pd.DataFrame({"chunk": chunk, "sample": str(sample), "site": sites, "gp0": g[:, 0], "gp1": g[:, 1], "gp2": g[:, 2], "ds": g[:, 1] + 2 * g[:, 2], "h0": a, "h1": b}))
        return pd.concat(out)[columns]

    # little data, much work: as many tasks as asked for, not as few as the data would fill
    panels, placed = (x.repartition(tasks, "chunk", "block") for x in (panels, placed))
    return panels.groupBy("chunk", "block").cogroup(placed.groupBy("chunk", "block")).applyInPandas(work, SCHEMA)
