"""Spelling variants against all pairs."""

import random
import zlib
from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from strandlake.llm import variants

DOCS = "doc_id long, text string, lang string, source string, n_chars long, word string, n int, key string, path string, hot int, near string"
LETTERS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | {chr(c) for c in range(0xC0, 0x100)}


def make(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 1, "w", 2, "k", "p", 3, "n") for i, t in rows], DOCS).repartition(3)


def words_by_hand(rows):
    found = Counter()
    for i, t in rows:
        run = ""
        for c in (t or "") + " ":
            if c in LETTERS:
                run += chr(ord(c) + 32) if "A" <= c <= "Z" else c
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                found[run] += len(run) >= 7
                run = ""
    return {w: n for w, n in found.items() if n >= 2}


def edit_distance_is_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows, ratio=10):
    count = words_by_hand(rows)
    near = {w: [u for u in count if abs(len(u) - len(w)) < 2 and edit_distance_is_one(w, u)] for w in count}
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda u: (-count[u], u), default=None)
        if best is not None and count[best] >= ratio * count[w]:
            form[w] = best
    out = {}
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), count[form[w]] if w in form else None)
    return out, near


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    stem = ["".join(rng.choices("abcdé", k=rng.randrange(7, 10))) for _ in range(25)] + ["common" + "".join(rng.choices("ab", k=4)) for _ in range(25)]

    def typo(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abz×É") + w[i:], w[:i] + rng.choice("abz") + w[i + 1 :]])

    texts = []
    for _ in range(120):
        some = [rng.choice(stem) for _ in range(25)]
        texts.append(" ".join(w if rng.random() < 0.85 else typo(w).capitalize() if rng.random() < 0.8 else typo(typo(w)) for w in some))
    long = "".join(rng.choices("abcdef", k=3_000))
    texts += [f"{long} {long[:-1]} {long}-{long[:-1]} {long[:900]}x{long[901:]}.{long[:900]}x{long[901:]}"]  # very long words
    texts += ["tessera " * 100 + "tesserae " * 10 + "tesseraes tesseraes", "Ünïcödé Ünïcödé ünïcödé ünïcödé ÜNÏCÖDÉ ÜNÏCÖDÉ", "aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa aaaaaaaaa aaaaaaaaa", "", None, " \n", "short words only"]
    found = list(enumerate(texts))
    return [*found, (None, texts[0]), (3, texts[3]), (3, texts[3]), (3, "another text with the same identifier")]


@pytest.mark.parametrize("most", [5_000, 3])
def test_variants(spark, rows, most):
    """Also where nearly every segment is divided."""
    expected, _ = variants_by_hand(rows)
    found = variants.variants(make(spark, rows), most=most, shard=50).collect()
    assert len(found) == len(expected)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found} == expected
    assert any(v[1] != v[0] for v in expected.values() if v[0]) and max(v[3] for v in expected.values()) > 5


@pytest.mark.parametrize("most", [5_000, 4])
def test_pairs(spark, rows, most):
    _, near = variants_by_hand(rows)
    found = variants.near_pairs(variants.words(make(spark, rows)), most=most, shard=50).collect()
    assert sorted((r["word"], r["near"]) for r in found) == sorted((w, u) for w, some in near.items() for u in some)


def test_segments_are_divided(spark):
    rng = random.Random(2)
    words = sorted({"samesame" + "".join(rng.choices("abcdefgh", k=8)) for _ in range(300)})
    counted = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    entries, _ = variants.segments(counted, most=20)
    assert entries.groupBy("path", "key").count().agg({"count": "max"}).first()[0] <= 20
    assert {r["path"] for r in entries.select("path").distinct().collect()} >= {"B", "AA", "AB"}


@given(st.text("abé", max_size=6), st.text("abé", max_size=6))
def test_one_edit(a, b):
    assert variants.one_edit(a, b) == edit_distance_is_one(a, b)
    held = variants.Held()
    held.add(a, ("w", 1))
    assert len(list(held.near(b))) == edit_distance_is_one(a, b)


@given(st.text("ab", min_size=44, max_size=52), st.integers(0, 44), st.sampled_from(["", "a", "b"]))
def test_rests_of_any_length(a, i, c):
    b = a[:i] + c + a[i + 1 :]
    held = variants.Held()
    held.add(a, ("w", 1))
    assert len(list(held.near(b))) == edit_distance_is_one(a, b) and len(list(held.near(a))) == 0


def test_roots(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("x", "w5"), ("y", "x")]
    assert {r["word"]: r["root"] for r in variants.roots(spark.createDataFrame(chain, "word string, form string")).collect()} == {w: "w13" for w, _ in chain}


def test_no_words(spark):
    assert variants.variants(make(spark, [])).count() == 0 and variants.variants(make(spark, [(1, None), (2, "few")])).count() == 0
