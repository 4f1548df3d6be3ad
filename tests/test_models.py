"""Kernels against enumeration and recovery of planted haplotypes."""

import itertools

import numpy as np
import pytest

from strandlake.operators import imputation


def enumerate_paths(x, hl, t, e):
    """Posteriors of alleles by summing over all state paths."""
    sites, k = x.shape
    mixed = hl * (1 - e) + hl[:, ::-1] * e
    mixed /= mixed.sum(axis=1, keepdims=True)
    total = np.zeros((sites, 2))
    for path in itertools.product(range(k), repeat=sites):
        p = 1.0 / k
        for l, s in enumerate(path):
            if l:
                p *= (1 - t[l]) * (s == path[l - 1]) + t[l] / k
            p *= mixed[l][x[l, s]]
        for l, s in enumerate(path):
            total[l, x[l, s]] += p / mixed[l][x[l, s]]
    out = np.stack([total[:, 0] * (1 - e) + total[:, 1] * e, total[:, 0] * e + total[:, 1] * (1 - e)], axis=1) * hl
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward_small():
    x = np.array([[0, 1, 1], [0, 0, 1], [1, 1, 0]])
    hl, t = np.array([[0.9, 0.1], [0.5, 0.5], [0.2, 0.8]]), np.array([0.0, 0.1, 0.3])
    none = np.zeros(3, dtype=bool)
    found = imputation.impute(x, hl, none, none, t, 0.01)
    assert np.allclose(found, [[0.859228, 0.140772], [0.933985, 0.066015], [0.055750, 0.944250]], atol=1e-6)


def test_forward_backward_random():
    rng = np.random.default_rng(1)
    for _ in range(5):
        x = rng.integers(0, 2, (5, 3))
        x[:, 0], x[:, 1] = 0, 1  # all sites polymorphic
        hl = rng.uniform(0.05, 0.95, (5, 1))
        hl = np.concatenate([hl, 1 - hl], axis=1)
        t = np.concatenate([[0.0], rng.uniform(0.01, 0.5, 4)])
        none = np.zeros(5, dtype=bool)
        assert np.allclose(imputation.impute(x, hl, none, none, t, 0.01), enumerate_paths(x, hl, t, 0.01))


def likelihood(x, hap, t, e):
    """Of a haplotype as a copy with errors of a panel, by a forward pass."""
    a = np.full(x.shape[1], 1.0 / x.shape[1])
    for l, allele in enumerate(hap):
        if l:
            a = a * (1 - t[l]) + t[l] * a.mean()
        a = a * np.where(x[l] == allele, 1 - e, e)
    return a.sum()


@pytest.mark.parametrize(("hets", "near"), [((1, 4), 0.03), ((0, 1, 2), 0.03), ((0, 2, 3, 5), 0.03), ((0, 1, 2, 4, 5, 7), 0.03), ((0, 1, 2, 3, 4, 5, 6, 8), 0.12)])
def test_phase_draws_by_enumeration(hets, near):
    """All phasings of a few heterozygotes, weighted by the likelihoods of both haplotypes: exact for two segments, near for three."""
    rng = np.random.default_rng(len(hets))
    sites, e = 9, 0.05
    x = rng.integers(0, 2, (sites, 4))
    t = np.concatenate([[0.0], rng.uniform(0.02, 0.3, sites - 1)])
    h0 = rng.integers(0, 2, sites)
    h1 = h0.copy()
    h0[list(hets)], h1[list(hets)] = 0, 1
    weights = {}
    for bits in itertools.product((0, 1), repeat=len(hets)):
        a, b = h0.copy(), h1.copy()
        a[list(hets)], b[list(hets)] = bits, [1 - v for v in bits]
        weights[bits] = likelihood(x, a, t, e) * likelihood(x, b, t, e)
    total, n, found = sum(weights.values()), 4000, {}
    for _ in range(n):
        a, b = imputation.phase(x, h0, h1, t, e, rng)
        assert np.array_equal(a + b, h0 + h1)
        key = tuple(a[list(hets)].tolist())
        found[key] = found.get(key, 0) + 1
    apart = sum(abs(found.get(k, 0) / n - w / total) for k, w in weights.items()) / 2
    assert apart < near + np.sqrt(len(weights) / n) / 2


def test_prefix_orders():
    rng = np.random.default_rng(2)
    panel = rng.integers(0, 2, (6, 20))
    orders = imputation.prefix_orders(panel)
    for l in range(6):
        expected = sorted(range(20), key=lambda h: tuple(panel[: l + 1, h][::-1]))
        assert orders[l].tolist() == expected
    # a copy of a panel haplotype has it as a neighbour
    hap = panel[:, 7]
    states = imputation.select_states(panel, orders, hap, np.arange(6), 3, 8)
    assert any((panel[:, s] == hap).all() for s in states)


def test_neighbours_without_scans_of_the_panel():
    """With ones_before at hand a target's places need no haplotype but their own; neighbours are those of a search one by one."""
    class Shape:
        def __init__(self, shape):
            self.shape = shape

    rng = np.random.default_rng(5)
    panel = (rng.random((30, 200)) < rng.random((30, 1))).astype(np.uint8)
    orders = imputation.prefix_orders(panel)
    ones = imputation.ones_before(panel, orders)
    for _ in range(20):
        hap = (rng.random(30) < 0.5).astype(np.int64)
        at = imputation.matches(Shape(panel.shape), None, hap, ones)
        for l in range(30):  # those whose reversed prefix is less, equal alleles in order of the panel's columns
            less = sum(tuple(panel[: l + 1, k][::-1]) < tuple(hap[: l + 1][::-1]) for k in range(200))
            assert at[l] == less
        chosen, depth, most = np.array([3, 11, 29]), int(rng.integers(1, 9)), int(rng.integers(1, 40))
        found = {}
        for ring in range(1, depth + 1):
            for l in chosen[::-1]:
                for k in (at[l] - ring, at[l] + ring - 1):
                    if 0 <= k < 200 and panel[l][orders[l][k]] == hap[l] and len(found) < most:
                        found.setdefault(int(orders[l][k]))
        assert imputation.select_states(panel, orders, hap, chosen, depth, most, ones).tolist() == sorted(found)


def mosaic(rng, panel, switches):
    sites, k = panel.shape
    out, cuts = np.empty(sites, dtype=int), sorted(rng.choice(sites, switches, replace=False))
    for a, b in zip([0, *cuts], [*cuts, sites], strict=True):
        out[a:b] = panel[a:b, rng.integers(k)]
    return out


@pytest.mark.parametrize(("k_pbwt", "least"), [(40, 0.85), (24, 0.6)])
def test_recovery(k_pbwt, least):
    rng = np.random.default_rng(3)
    panel = (rng.random((80, 40)) < rng.uniform(0.1, 0.9, (80, 1))).astype(int)
    a, b = mosaic(rng, panel, 1), mosaic(rng, panel, 1)
    g = a + b
    seen = rng.random(80) < 0.5
    gp = np.full((80, 3), 1 / 3)
    gp[seen] = 0.001
    gp[seen, g[seen]] = 0.998
    o = imputation.ModelOptions(burnin=3, main=5, ne=200.0, k_pbwt=k_pbwt, k_init=40)
    p, h0, h1 = imputation.gibbs(panel, np.arange(80) * 0.05, gp, ~seen, np.zeros(80, dtype=bool), o, 0, "s")
    ds = p[:, 1] + 2 * p[:, 2]
    assert np.corrcoef(ds, g)[0, 1] ** 2 > least
    assert np.allclose(p.sum(axis=1), 1)
    again = imputation.gibbs(panel, np.arange(80) * 0.05, gp, ~seen, np.zeros(80, dtype=bool), o, 0, "s")
    assert np.array_equal(again[0], p)  # keyed draws


def test_phasing_recovers_order():
    rng = np.random.default_rng(4)
    panel = rng.integers(0, 2, (40, 30))
    a, b = panel[:, 3].copy(), panel[:, 17].copy()
    mixed = rng.random(40) < 0.5
    h0, h1 = np.where(mixed, a, b), np.where(mixed, b, a)
    n0, n1 = imputation.phase(panel, h0, h1, np.full(40, 1e-4), 1e-4, rng)
    same = (n0 == a) & (n1 == b)
    assert (n0 + n1 == a + b).all() and (same[a != b].all() or not same[a != b].any())


def test_segments():
    het = np.array([1, 1, 0, 1, 1, 0, 1, 1, 1], dtype=bool)
    assert imputation.segments(het).tolist() == [0, 0, 0, 0, 1, 1, 1, 1, 2]


def test_imputation_query_is_whole(spark, sf_dir, monkeypatch):
    """Every target sample, with the default iterations; only counted here, not run."""
    from strandlake.plans import adapters, catalog

    asked = {}
    monkeypatch.setattr(imputation, "run", lambda packed, targets, options: asked.update(targets=targets, options=options))
    catalog.mdl_06_15_imputation(spark, sf_dir)
    samples = adapters.panel(spark, sf_dir).filter("hap % 5 = 0").selectExpr("hap div 10 AS sample").distinct().count()
    assert asked["targets"].select("sample").distinct().count() == samples > 10
    default = imputation.ModelOptions()
    assert (asked["options"].burnin, asked["options"].main) == (default.burnin, default.main) == (5, 15)
