"""Operator 13: spelling variants of words, found by Aho-Corasick automata over halves of words.

Words that are one inserted, deleted or replaced code point apart share one of two halves: the first half of one opens
the other, or its second half ends it. So every word is entered with two segments. Entries are dealt to shards by a hash of
the segment, a shard builds one automaton of its segments, and every word is scanned in the (at most six) shards that
can hold a segment of it. A segment is written `ending|opening`, and the word u is scanned as `u|u`: what matches stands
at the right offset by itself. Lengths are compared, and the distance is verified on what the segment leaves of both words.

A segment that more than MOST words hold is too large for a shard. What it leaves of its words is halved again, and
segment and new half together are the entries (paths of A, opening, and B, ending), as often as needed. Of all paths by
which two words meet only the first counts, so that each pair is found once and pairs need no second shuffle.

A word's form is the near word with the largest count (ties: the smallest in code point order), if it has at least RATIO
times the word's count. Its root is where following forms ends, by pointer doubling.

Defined results: a null text has no words; a null doc_id is written as nothing where runs are drawn for an edit; equal rows
count each; very long texts and very long words are used whole; ties as above; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words have so many code points at least, and so many occurrences.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form has so many times the count of its word.
RATIO = 10
#: A run whose hash this number divides loses a code point.
EVERY = 31
#: Entries of a shard, about.
SHARD = 20_000
#: A segment that more words hold is divided.
MOST = 5_000
#: Hot segments are looked up by so many parts.
SALTS = 16
#: What a segment leaves of a word is indexed by its deletions up to this length, and compared beyond.
INDEXED = 48
#: Distinct words that a task gathers before it passes them on.
GATHERED = 200_000

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def run_words(doc_id: int | None, text: str | None, least: int = LEAST_LENGTH, every: int = EVERY) -> Iterator[tuple[str, int]]:
    """The words of a text, of least code points or more, with their occurrences in it; a word may come more than once."""
    own = "" if doc_id is None else str(doc_id)
    runs: Counter = Counter()
    for run, n in Counter(w for w in RUNS.findall(text or "") if len(w) >= least).items():
        runs[run if run.islower() else run.translate(LOWER)] += n
    for run, n in runs.items():
        h = zlib.crc32(f"{own}:{run}".encode())
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least:
                continue
        yield run, n


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """word, n: the distinct words of all texts with their occurrences. Tasks add up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                for word, n in run_words(i.as_py(), text.as_py(), least_length, every):
                    found[word] += n
                if len(found) >= GATHERED:
                    yield out()
                    found.clear()
        if found:
            yield out()

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# segments -------------------------------------------------------------------------------------------------


def context(word: str, path: str) -> tuple[int, int]:
    """How many code points of a word's opening and ending a path's segment holds."""
    left = right = 0
    for step in path:
        r = len(word) - left - right
        if step == "A":
            left += r // 2
        else:
            right += r - r // 2
    return left, right


def first_path(word: str, other: str, path: str) -> bool:
    """Whether no earlier path than this one brings the two together: each B is taken only where A fails."""
    left = right = 0
    for step in path:
        r = len(word) - left - right
        half = r // 2
        if step == "A":
            left += half
        elif word[left : left + half] == other[left : left + half]:
            return False
        else:
            right += r - half
    return True


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point tells a from b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    low, high = 0, len(a)  # a[:low] == b[:low], found by halving
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return a[low + (len(a) == len(b)) :] == b[low + 1 :]


@dataclass
class Held:
    """The words of one segment and path, by what the segment leaves of them."""

    whole: dict[str, tuple] = field(default_factory=dict)
    replaced: dict[str, list[tuple]] = field(default_factory=dict)
    shorter: dict[str, list[tuple]] = field(default_factory=dict)
    long: dict[int, list[tuple]] = field(default_factory=dict)

    def add(self, rest: str, entry: tuple) -> None:
        if len(rest) > INDEXED:
            self.long.setdefault(len(rest), []).append((rest, entry))
            return
        self.whole[rest] = entry
        before = None
        for i in range(len(rest)):
            a, b = rest[:i], rest[i + 1 :]
            self.replaced.setdefault(f"{a}|{b}", []).append(entry)
            if (less := a + b) != before:  # equal deletions are neighbours
                self.shorter.setdefault(less, []).append(entry)
                before = less

    def near(self, rest: str) -> Iterator[tuple]:
        """Entries whose rest is one edit from this one, each once."""
        if len(rest) >= INDEXED:
            for n in (len(rest) - 1, len(rest), len(rest) + 1):
                yield from (e for r, e in self.long.get(n, ()) if one_edit(r, rest))
            if len(rest) > INDEXED + 1:
                return
        yield from self.shorter.get(rest, ())
        own = self.whole.get(rest)
        before = None
        for i in range(len(rest)):
            a, b = rest[:i], rest[i + 1 :]
            if len(rest) <= INDEXED:
                for e in self.replaced.get(f"{a}|{b}", ()):
                    if e is not own:
                        yield e
            if (less := a + b) != before:
                before = less
                if less in self.whole:
                    yield self.whole[less]


class Automaton:
    """One shard: segments as patterns, each with the words that hold it, by path."""

    def __init__(self, entries: Iterator[tuple[str, int, str]]):
        held: dict[str, dict[str, Held]] = {}
        for word, n, path in entries:
            left, right = context(word, path)
            end = len(word) - right
            held.setdefault(f"{word[end:]}|{word[:left]}", {}).setdefault(path, Held()).add(word[left:end], (word, n))
        self.automaton = ahocorasick.Automaton()
        for segment, by_path in held.items():
            at = segment.index("|")
            self.automaton.add_word(segment, (len(segment) - at - 1, at, by_path))
        if held:
            self.automaton.make_automaton()
        self.empty = not held

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """The shard's words near this one, with their counts, each by its first path."""
        if self.empty:
            return
        for _, (left, right, by_path) in self.automaton.iter(f"{word}|{word}"):
            if left + right <= len(word):
                rest = word[left : len(word) - right]
                for path, held in by_path.items():
                    for entry in held.near(rest):
                        if first_path(entry[0], word, path):
                            yield entry


def _cut(left: Column, right: Column, rest: Column, path: Column | None) -> Column:
    """The two segments that a word with so many code points left is entered with."""
    half = F.call_function("div", rest, F.lit(2)).cast("int")
    names = lambda p, a, b: F.struct(F.concat(path, F.lit(p)).alias("path"), a.cast("int").alias("left"), b.cast("int").alias("right"))
    return F.array(names("A", left + half, right), names("B", left, right + rest - half))


def _rest() -> Column:
    """How many code points the segment leaves."""
    return F.length("word") - F.col("left") - F.col("right")


def _key(df: DataFrame) -> DataFrame:
    return df.withColumn("key", F.expr("concat(substring(word, length(word) - right + 1, right), '|', substring(word, 1, left))"))


def halved(entries: DataFrame) -> DataFrame:
    """Each entry as two, one segment further."""
    cut = F.explode(_cut(F.col("left"), F.col("right"), _rest(), F.col("path")))
    return _key(entries.withColumn("cut", cut).select("word", "n", "cut.*"))


def probed(probes: DataFrame) -> DataFrame:
    """For each probe all segments that a word near it could be entered with, one segment further."""
    lengths = F.sequence(F.greatest(_rest() - 1, F.lit(0)), _rest() + 1)
    cuts = F.flatten(F.transform(lengths, lambda r: _cut(F.col("left"), F.col("right"), r, F.col("path"))))
    cuts = F.array_distinct(F.filter(cuts, lambda c: c["left"] + c["right"] <= F.length("word")))
    return _key(probes.withColumn("cut", F.explode(cuts)).select("word", "cut.*"))


def _parted(df: DataFrame, hot: DataFrame) -> DataFrame:
    """df, kept, with `hot` told: by salts, as a hot segment may hold a third of all rows."""
    salted = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("hot", F.lit(True))
    dealt = df.withColumn("salt", F.pmod(F.xxhash64("word"), F.lit(SALTS)).cast("int"))
    return common.cut_lineage(dealt.join(salted, ["path", "key", "salt"], "left").drop("salt"))


def segments(counted: DataFrame, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Entries (word, n, path, key) and probes (word, path, key). No key has more than `most` entries that could be divided."""
    start = counted.withColumns({"path": F.lit(""), "left": F.lit(0), "right": F.lit(0)})
    entries, probes = halved(start), probed(start.drop("n"))
    done: list[tuple[DataFrame, DataFrame]] = []
    while True:
        hot = entries.filter(_rest() > 1).groupBy("path", "key").agg(F.count("*").alias("c")).filter(F.col("c") > most).select("path", "key")
        hot = common.cut_lineage(hot)
        if hot.isEmpty():
            break
        entries, probes = _parted(entries, hot), _parted(probes, hot)
        done.append(tuple(x.filter(F.col("hot").isNull()).drop("hot") for x in (entries, probes)))
        entries, probes = halved(entries.filter("hot").drop("hot")), probed(probes.filter("hot").drop("hot"))
    for e, p in done:
        entries, probes = entries.unionByName(e), probes.unionByName(p)
    return entries.select("word", "n", "path", "key"), probes.select("word", "path", "key")


# near words -----------------------------------------------------------------------------------------------

NEAR = "word string, n_near long, best string, best_n long"
PAIRS = "word string, near string, near_n long"


def _near(entries: pa.Table, probes: pa.Table) -> pa.Table:
    """Of each probed word: how many words of this shard are near, and which counts most."""
    shard = Automaton(zip(*(entries.column(c).to_pylist() for c in ("word", "n", "path")), strict=True))
    rows: list[tuple] = []
    for word in dict.fromkeys(probes.column("word").to_pylist()):
        n, best = 0, ("", 0)
        for entry in shard.near(word):
            n += 1
            if entry[1] > best[1] or (entry[1] == best[1] and entry[0] < best[0]):
                best = entry
        if n:
            rows.append((word, n, *best))
    return _table(rows, [("word", pa.string()), ("n_near", pa.int64()), ("best", pa.string()), ("best_n", pa.int64())])


def _pairs(entries: pa.Table, probes: pa.Table) -> pa.Table:
    shard = Automaton(zip(*(entries.column(c).to_pylist() for c in ("word", "n", "path")), strict=True))
    rows = [(word, *e) for word in dict.fromkeys(probes.column("word").to_pylist()) for e in shard.near(word)]
    return _table(rows, [("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _table(rows: list[tuple], fields: list[tuple]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else ([] for _ in fields)
    return pa.Table.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True)], names=[k for k, _ in fields])


def _searched(counted: DataFrame, most: int, shard: int, search, schema: str) -> DataFrame:
    entries, probes = segments(counted, most)
    n = max(common.partitions(counted.sparkSession), -(-entries.count() // shard))
    dealt = F.pmod(F.xxhash64("path", "key"), F.lit(n)).alias("shard")
    entries, probes = entries.select("word", "n", "path", dealt), probes.select("word", dealt)
    return entries.groupBy("shard").cogroup(probes.groupBy("shard")).applyInArrow(search, schema)


def near_pairs(counted: DataFrame, most: int = MOST, shard: int = SHARD) -> DataFrame:
    """word, near, near_n: all near words of each of the words (word, n)."""
    return _searched(common.cut_lineage(counted), most, shard, _pairs, PAIRS)


def variants(docs: DataFrame, ratio: int = RATIO, most: int = MOST, shard: int = SHARD) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    counted = common.cut_lineage(words(docs))
    near = _searched(counted, most, shard, _near, NEAR).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))).alias("top")
    )
    known = counted.join(near, "word", "left")
    has = -F.col("top.less") >= F.col("n") * ratio
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("top.best")).alias("form"), F.when(has, -F.col("top.less")).alias("form_n"))
    known = common.cut_lineage(known)
    return known.join(roots(known.filter(F.col("form").isNotNull()).select("word", "form")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): each round follows twice as many forms; counts grow along them, so they never meet again."""
    at = common.cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.join(further, "root", "left")
        at = common.cut_lineage(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if at.filter("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")
