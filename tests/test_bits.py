"""Codecs of rows of bits: round trips and counts."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.functions import bits
from strandlake.operators import panels
from strandlake.plans import adapters

ROWS = st.lists(st.tuples(st.integers(0, 1), st.integers(1, 400)), max_size=12).map(lambda runs: np.concatenate([np.zeros(0, np.uint8), *(np.full(n, v, np.uint8) for v, n in runs)]))


@settings(max_examples=150, deadline=None)
@given(ROWS)
def test_round_trips(row):
    assert np.array_equal(bits.decode_runs(bits.encode_runs(row)), row)
    words = bits.encode_words(row)
    assert np.array_equal(bits.decode_words(words, len(row)), row) and bits.count_ones(words) == row.sum()
    for a, b in ((0, len(row)), (len(row) // 3, len(row) // 2), (len(row) // 2, len(row))):
        assert np.array_equal(bits.pull(words, a, b), row[a:b])
    assert np.array_equal(bits.unpack(bits.pack(row[None]), len(row))[0], row)


def test_long_fills_take_several_words():
    row = np.zeros(bits.GROUP * bits.LONGEST * 2 + 40, np.uint8)
    row[-1] = 1
    words = bits.encode_words(row)
    assert len(words) == 4 and np.array_equal(bits.decode_words(words, len(row)), row) and len(bits.encode_runs(row)) <= 5


def test_bits_of_packed_rows():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 2, (5, 37))
    p = bits.pack(rows)
    assert all(bits.get(p, i, j) == rows[i, j] for i in range(5) for j in range(37)) and np.array_equal(bits.get(p, 2, np.arange(37)), rows[2])
    bits.put(p, 1, 20, 1 - rows[1, 20])
    bits.fill(p, 3, 1)
    rows[1, 20], rows[3] = 1 - rows[1, 20], 1
    assert np.array_equal(bits.unpack(p, 37), rows)


def test_prefix_orders():
    """Advancing site by site sorts haplotypes by their reversed prefixes."""
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2, (30, 12))
    order = np.arange(30)
    for k in range(12):
        a = bits.decode_runs(bits.encode_runs(h[order, k].astype(np.uint8)))
        order, zeros = bits.advance(order, a)
        assert zeros[-1] == (a == 0).sum()
    assert order.tolist() == sorted(range(30), key=lambda i: (h[i, ::-1].tolist(), i))


@pytest.mark.parametrize("threshold", [0, 25, 1000])
def test_encoded_lines(spark, sf_dir, threshold):
    p = adapters.panel(spark, sf_dir)
    lines = panels.encoded_lines(p, threshold)
    kinds = {r["site"]: r["encoding"] for r in lines.collect()}
    assert kinds == {r["site"]: r["encoding"] for r in panels.encodings(p, threshold).collect()}
    back = panels.decoded_lines(lines)
    assert back.exceptAll(p.select(*back.columns)).isEmpty() and back.count() == p.count()
    ones = {r["site"]: r["n"] for r in p.groupBy("site").agg(F.sum("allele").alias("n")).collect()}
    assert {r["site"]: r["ones"] for r in lines.collect()} == ones
