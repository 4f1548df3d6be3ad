"""Operator 4: toxicity by a weighted lexicon matched with an Aho-Corasick automaton.

Texts are folded first: compatibility forms and case (NFKC, lower case), letters that look like Latin
ones, digits and signs that stand for letters inside words (word by word: those before the word's last letter,
and ! and | only behind a first one). Lexicon entries are word beginnings and
whole words with weights (log odds); they count only where a word begins, the longest entry per word.
Exception phrases, of one to three words, are entries of the same automaton that cancel the entries they cover. The weight
found, by itself and per length, is turned into a score between 0 and 1 by a logistic function.

Learning reads at most MAX_TOXIC and MAX_CLEAN labelled documents (those smallest by a hash of
doc_id), the only bound: all word beginnings of toxic documents with clearly higher document frequency there become
entries; of the words that begin with an entry, and the phrases that such a word opens, those that stand in clean
documents without being clearly more frequent in toxic ones become exceptions, whether toxic ones have them or not.

Defined results: null and empty texts score as texts without any match; several labels of one document
count as toxic if one is; null labels are skipped; without labels of both kinds there is no lexicon
and all scores are 0 (1 if there are toxic labels only); ties and repeated rows are scored each, by their texts
alone; very long texts are folded and searched whole; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The most labelled documents that learning reads.
MAX_TOXIC, MAX_CLEAN = 6_000, 14_000
#: Lengths of word beginnings that may become entries.
SHORTEST, LONGEST = 3, 12
THRESHOLD = 0.7

#: Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝвкмнтαεικνορτυχ", "aeopcyxijshdqwbkmhtaeiknoptux", strict=True))
#: Digits and signs that stand for letters inside words.
STAND_INS = dict(zip("013457@$!|", "oieastasil", strict=True))

FOLD = {ord(k): v for k, v in LOOKALIKES.items()}
SIGNS = {ord(k): v for k, v in STAND_INS.items()}
#: Stand-ins right before a letter.
MASKED = re.compile(r"[\d@$!|]+(?=[^\W\d_])")
WORD = re.compile(r"[^\W\d_]+")
#: A word with up to two more behind single blanks.
PHRASE = re.compile(r"(?<![^\W\d_])([^\W\d_]+)(?= ([^\W\d_]+)(?: ([^\W\d_]+))?)?")


def unmasked(m: re.Match) -> str:
    """Letters for the stand-ins; ! and | that open a word stay."""
    run, at = m[0], m.start()
    rest = run if at and m.string[at - 1].isalpha() else run.lstrip("!|")
    return run[: len(run) - len(rest)] + rest.translate(SIGNS)


def fold(text: str) -> str:
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(FOLD)
    else:
        text = text.lower()
    return MASKED.sub(unmasked, text)


@dataclass
class Model:
    entries: dict[str, float] = field(default_factory=dict)  # a trailing blank asks for the word's end
    exceptions: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=lambda: [-20.0, 0.0, 0.0, 0.0])

    def automaton(self) -> ahocorasick.Automaton | None:
        """Each string with its weight as a beginning, as a whole word, and whether it is an exception."""
        told: dict[str, list] = {}
        for k, w in self.entries.items():
            told.setdefault(k.rstrip(), [0.0, 0.0, False])[int(k[-1] == " ")] = w
        for k in self.exceptions:
            told.setdefault(k, [0.0, 0.0, False])[2] = True
        if not told:
            return None
        a = ahocorasick.Automaton()
        for k, v in told.items():
            a.add_word(k, (len(k), *v))
        a.make_automaton()
        return a

    def found(self, automaton, text: str) -> tuple[float, int]:
        """The summed weight of the entries in a folded text, and their number."""
        if automaton is None:
            return 0.0, 0
        longest: dict[int, tuple[int, float]] = {}
        covered: list[tuple[int, int]] = []
        for end, (size, begins, whole, exception) in automaton.iter(text):
            start, end = end - size + 1, end + 1
            if start and text[start - 1].isalpha():
                continue
            ends = end == len(text) or not text[end].isalpha()
            if exception and ends:
                covered.append((start, end))
            weight = max(begins, whole) if ends else begins
            if weight and longest.get(start, (0, 0.0))[0] < size:
                longest[start] = (size, weight)
        if covered:
            covered.sort()
            gone, reach, k = set(), -1, 0
            for start in sorted(longest):
                while k < len(covered) and covered[k][0] <= start:
                    reach, k = max(reach, covered[k][1]), k + 1
                if start < reach:
                    gone.add(start)
            longest = {k: v for k, v in longest.items() if k not in gone}
        return sum(w for _, w in longest.values()), len(longest)

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.clip(expand(features) @ np.array(self.weights), -30, 30)
        return 1.0 / (1.0 + np.exp(-z))


def expand(features: np.ndarray) -> np.ndarray:
    """From (weight, matches, characters): a constant, the weight, its density and whether there is any."""
    weight, n, size = features.T
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(1000.0 * weight / (size + 200.0)), (n > 0).astype(float)], axis=1)


def _beginnings(text: str) -> set[str]:
    found = set()
    for w in set(WORD.findall(fold(text))):
        found.add(w + " ")
        found.update(w[:n] for n in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return found


def _phrases(text: str, entries: Entries) -> set[str]:
    """The words that begin with an entry, and the phrases of two and three words that they open."""
    found = set()
    for m in PHRASE.finditer(fold(text)):
        if entries.starts(m[1]):
            found.update(" ".join(m.group(*range(1, k + 1)) if k > 1 else (m[1],)) for k in range(1, 4) if m[k] is not None)
    return found


class Entries:
    """Word beginnings, and whole words with a trailing blank."""

    def __init__(self, entries: Iterable[str]) -> None:
        self.all = frozenset(entries)

    def starts(self, word: str) -> bool:
        return any(word[:n] in self.all for n in range(SHORTEST, min(LONGEST, len(word)) + 1)) or word + " " in self.all


def _document_counts(docs: DataFrame, of: Callable[[str], set[str]], least: int) -> dict[str, int]:
    """In how many documents each of the strings stands that `of` gives for a text; those of fewer than least are left out."""

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                c.update(of(text or ""))
        items = list(c.items())
        for i in range(0, len(items), 50_000):
            part = items[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([n for _, n in part], pa.int64())], names=["entry", "n"])

    counted = docs.select("text").mapInArrow(process, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return {r["entry"]: r["n"] for r in counted.collect()}  # of a sample of bounded size


#: An entry stands in so many toxic documents of the sample at least.
LEAST = 5
#: An exception stands in so many clean documents of the sample at least.
CLEAN = 3


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> list[float]:
    """Logistic regression by Newton steps, with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        w += np.linalg.solve(hessian, x.T @ (y - p) - 0.05 * w)
    return [round(float(v), 9) for v in w]


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Learn from documents with labels: docs (doc_id, text), labels (doc_id, toxic)."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = marked.filter("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(marked.filter("toxic = 0").orderBy(*order).limit(max_clean))
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most max_toxic + max_clean rows
    sample = common.cut_lineage(sample.filter("text IS NOT NULL"))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Model(weights=[20.0 if toxic else -20.0, 0.0, 0.0, 0.0])
    ill, well = sample.filter("toxic = 1"), sample.filter("toxic = 0")
    a = _document_counts(ill, _beginnings, LEAST)
    known = frozenset(a)
    b = _document_counts(well, lambda t: _beginnings(t) & known, 1)

    def log_odds(n: int, m: int) -> float:
        return math.log((n + 0.5) / (toxic + 1.0)) - math.log((m + 0.5) / (clean + 1.0))

    odds = {k: log_odds(n, b.get(k, 0)) for k, n in a.items()}
    entries: dict[str, float] = {}
    for k in sorted(odds, key=lambda k: (len(k), k)):
        n = a[k]
        surprise = n * odds[k]
        shorter = [entries[k[:i]] for i in range(SHORTEST, len(k)) if k[:i] in entries]
        if odds[k] >= 1.5 and surprise >= 20 and n >= LEAST and (not shorter or odds[k] > max(shorter) + 0.7):
            entries[k] = round(odds[k], 6)
    entries = dict(sorted(entries.items()))
    stems = Entries(entries)
    fine = _document_counts(well, lambda t: _phrases(t, stems), CLEAN)
    named = frozenset(fine)
    poor = _document_counts(ill, lambda t: _phrases(t, stems) & named, 1)
    low = {k for k, m in fine.items() if log_odds(poor.get(k, 0), m) < 0.7}
    # a phrase that a shorter exception opens adds nothing
    exceptions = sorted(k for k in low if not any(" ".join(k.split(" ")[:i]) in low for i in range(1, k.count(" ") + 1)))
    model = Model(entries, exceptions)
    rows = features(sample, model, "toxic").select("toxic", "weight", "matches", "size").collect()
    x = np.array([[r["weight"], r["matches"], r["size"]] for r in rows], dtype=np.float64)
    y = np.array([r["toxic"] for r in rows], dtype=np.float64)
    order_ = np.lexsort((x[:, 2], x[:, 1], x[:, 0], y))
    model.weights = _fit(expand(x[order_]), y[order_])
    return model


def features(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Weight and number of matches and length of every text, with its score; keep: integer columns to keep."""
    columns = [*keep]

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            texts = batch.column(len(columns)).to_pylist()
            rows = [(*model.found(automaton, fold(t or "")), len(t or "")) for t in texts]
            x = np.array(rows, dtype=np.float64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x[:, 0]), pa.array(x[:, 1].astype(np.int64)), pa.array(x[:, 2].astype(np.int64)), pa.array(model.score(x))], names=[*columns, "weight", "matches", "size", "score"])

    schema = ", ".join(f"{c} long" for c in columns)
    source = docs.select(*(F.col(c).cast("long").alias(c) for c in columns), "text")
    return source.mapInArrow(process, f"{schema}, weight double, matches long, size long, score double")


def held_out():
    """Whether a row is kept from learning, by its doc_id alone."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels that aren't held out, then score every document."""
    model = train(docs, labels.filter(~held_out()))
    scored = features(docs, model, "doc_id")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "weight", "matches")
