"""Overlapping genomic windows from site lists."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lineage import cut_lineage
from .ranges import RANGE, in_order, previous, ranged, running, with_totals_before, within
from .ranges import keys as range_keys

#: Fixed value: end of a chromosome whose length isn't known.
NO_LENGTH = 1_248_956_422

SCHEMA = "chrom string, chunk int, buf_start long, buf_stop long, core_start long, core_stop long, cm double, bp long, n_variants long, n_common long"


@dataclass(frozen=True)
class ChunkOptions:
    """FLT-17. exact_buffer False keeps the whole-number reading of buffer centimorgans."""

    window_cm: float = 2.5
    window_mb: float = 2.0
    window_count: int = 20_000
    buffer_cm: float = 0.5
    buffer_mb: float = 0.4
    buffer_count: int = 2_000
    recursive: bool = False
    uniform: bool = False
    exact_buffer: bool = True

    def __post_init__(self) -> None:
        if min(self.window_cm, self.window_mb, self.buffer_cm, self.buffer_mb) < 0 or min(self.window_count, self.buffer_count) < 1:
            raise ValueError("window and buffer sizes must be positive")


# places -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Need:
    """What a site must have over another to end a window or a buffer: centimorgans (whole ones only, if asked), bases, places, common sites."""

    cm: float
    bp: float
    places: int
    common: int = 0
    floored: bool = False


@dataclass
class Side:
    """Sites in the direction of a search: place, position, centimorgans, common sites up to and with each; all ascending."""

    idx: np.ndarray
    pos: np.ndarray
    cm: np.ndarray
    upto: np.ndarray

    @classmethod
    def of(cls, idx: np.ndarray, pos: np.ndarray, cm: np.ndarray, upto: np.ndarray, back: bool = False) -> Side:
        """Rows in ascending order of place; looked at from the other end, with signs changed, if the search goes back."""
        return cls(*(-x[::-1] if back else x for x in (idx, pos, cm, upto)))

    @classmethod
    def asking(cls, idx: np.ndarray, pos: np.ndarray, cm: np.ndarray, before: np.ndarray, back: bool = False) -> Side:
        """Queries in their own order, with signs changed if the search goes back."""
        return cls(*(-x if back else x for x in (idx, pos, cm)), before)


def first_enough(at: Side, q: Side, need: Need, common: np.ndarray | int = 0) -> np.ndarray:
    """For each q (upto: common sites before it), the first place in `at` that meets all minima; len(at) if none does. Each is met from a place on."""
    n = len(at.idx)
    k = np.maximum(np.searchsorted(at.idx, q.idx + need.places), np.searchsorted(at.pos, q.pos + int(np.ceil(need.bp))))
    if need.common:
        k = np.maximum(k, np.searchsorted(at.upto, q.upto + common))

    def met(j: np.ndarray) -> np.ndarray:
        gap = at.cm[np.clip(j, 0, n - 1)] - q.cm
        return (np.floor(gap) if need.floored else gap) >= need.cm

    j = np.searchsorted(at.cm, q.cm + (np.ceil(need.cm) if need.floored else need.cm))
    while (back := (j > 0) & met(j - 1)).any():  # the sum above is rounded, the difference counts
        j = j - back
    while (on := (j < n) & ~met(j)).any():
        j = j + on
    return np.maximum(k, j)


def _renewed(df: DataFrame) -> DataFrame:
    """The same columns as others, so that a table can meet what was derived from it."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def _needed(need: Need, counts: dict[str, int] | None, chrom: str) -> Need:
    """With the places and common sites that a chromosome's count asks for."""
    return replace(need, places=counts[chrom] - 1, common=counts[chrom]) if counts else need


def _places(chrom: str, **places: list | np.ndarray) -> pa.Table:
    """Places of a chromosome, as tasks return them. Tasks take and return Arrow, so that no worker loads pandas, and one kind of worker does all."""
    columns = {n: pa.array(x, pa.int64()) for n, x in places.items()}
    return pa.table({"chrom": pa.array([chrom] * len(next(iter(columns.values()))), pa.string()), **columns})


LONG, TEXT, REAL, FLAG = pa.int64(), pa.string(), pa.float64(), pa.bool_()


def _small(spark: SparkSession, rows: list[tuple], **types: pa.DataType) -> DataFrame:
    """A small table, by way of Arrow: a list of rows would go through Python workers of another kind."""
    columns = zip(*rows, strict=True) if rows else [[] for _ in types]
    return spark.createDataFrame(pa.table({n: pa.array(list(x), t) for (n, t), x in zip(types.items(), columns, strict=True)}))


class Places:
    """Sites by place, in ranges of so many places: `rows` (chrom, idx, pos, cm, c, upto, range), kept; `ends` (by chromosome) has a row a range."""

    def __init__(self, sites: DataFrame, per_range: int):
        self.per_range = per_range
        c = F.col("is_common").cast("long")
        x = with_totals_before(ranged(sites.select("chrom", F.col("pos").cast("long").alias("pos"), F.col("cm").cast("double").alias("cm"), "is_common")), n_before=F.lit(1), common_before=c)
        w = within(x).orderBy("pos", "cm", "is_common")
        idx = F.col("n_before") + F.row_number().over(w) - 1
        x = x.select("chrom", idx.alias("idx"), "pos", "cm", c.alias("c"), (F.col("common_before") + F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("upto"))
        x = x.withColumn("range", F.expr(f"idx div {per_range}"))
        self.rows = cut_lineage(x.repartition(F.col("chrom"), F.col("range")))
        firsts = [F.min("idx").alias("first_idx"), F.min("pos").alias("first_pos"), F.min_by("cm", "idx").alias("first_cm")]
        lasts = [F.max("idx").alias("idx"), F.max("pos").alias("pos"), F.max_by("cm", "idx").alias("cm"), F.max("upto").alias("upto")]
        table = self.rows.groupBy("chrom", "range").agg(*firsts, *lasts).toPandas()  # a row for each per_range sites
        self.ends = {chrom: t.sort_values("range", ignore_index=True) for chrom, t in table.groupby("chrom")}
        self.last = {chrom: t.iloc[-1] for chrom, t in self.ends.items()}

    def pairs(self, need: Need, counts: dict[str, int] | None = None, back: bool = False) -> DataFrame:
        """(chrom, source, range, end, prev, final, places, common): for the queries of each range, the ranges that may hold what they reach.

        What places reach doesn't fall along a chromosome: those of a range reach between what its first and its last reach, so that there
        are fewer than two pairs a range. end is the place of a range that is reached last, prev that of the range before it.
        """
        rows: list[tuple] = []
        for chrom, t in self.ends.items():
            if counts and chrom not in counts:
                continue
            firsts, lasts = ([t[c].to_numpy() for c in names] for names in (("first_idx", "first_pos", "first_cm"), ("idx", "pos", "cm")))
            upto = t["upto"].to_numpy()
            own, n = _needed(need, counts, chrom), len(t)
            at = Side.of(*(firsts if back else lasts), upto, back)
            # common sites before the first of a range; with the last one, of which there may be one less before it
            ks = [first_enough(at, Side.asking(*x, before, back), own, own.common) for x, before in ((firsts, np.append(0, upto[:-1])), (lasts, upto))]
            ends = [{c: v.item() for c, v in zip(("idx", "pos", "cm", "upto"), e, strict=True)} for e in zip(*(firsts if back else lasts), upto, strict=True)]
            for source, (lo, hi) in enumerate(np.minimum(np.sort(np.stack(ks, axis=1), axis=1), n - 1).tolist()):
                for k in range(lo, hi + 1):
                    r, before = (n - 1 - k, n - k) if back else (k, k - 1)
                    rows.append((chrom, source, r, ends[r], ends[before] if k else None, k == n - 1, own.places, own.common))
        place = pa.struct([("idx", LONG), ("pos", LONG), ("cm", REAL), ("upto", LONG)])
        return _small(self.rows.sparkSession, rows, chrom=TEXT, source=LONG, range=LONG, end=place, prev=place, final=FLAG, places=LONG, common=LONG)

    def dealt(self, queries: DataFrame, need: Need, counts: dict[str, int] | None = None, back: bool = False) -> DataFrame:
        """Queries (asks) and places, by the pairs of ranges in which queries find what they reach; upto: for queries, common sites before.

        A query has one pair: its end meets all minima, the place before doesn't. A pair has no more than the places of two ranges, however many queries reach one range.
        """
        pairs = F.broadcast(self.pairs(need, counts, back))  # fewer than two rows a range

        def met(end: str) -> Column:
            idx, pos, cm = (F.col(c) - F.col(f"{end}.{c}") if back else F.col(f"{end}.{c}") - F.col(c) for c in ("idx", "pos", "cm"))
            gap = F.nanvl(cm, F.lit(None).cast("double"))
            all_met = (idx >= F.col("places")) & (pos >= F.lit(int(np.ceil(need.bp)))) & ((F.floor(gap) if need.floored else gap) >= F.lit(float(need.cm)))
            return F.coalesce(all_met & ((F.col("common") == 0) | (F.col(f"{end}.upto") - F.col("before") >= F.col("common"))), F.lit(False))  # without a map: none

        key, place = ("chrom", "source", "range"), ("idx", "pos", "cm")
        asked = queries.withColumn("source", F.expr(f"idx div {self.per_range}")).join(pairs, ["chrom", "source"])
        asked = asked.filter((F.col("prev").isNull() | ~met("prev")) & (F.col("final") | met("end"))).select(*key, *place, F.col("before").alias("upto"), F.lit(True).alias("asks"))
        held = _renewed(self.rows).join(pairs, ["chrom", "range"]).select(*key, *place, "upto", F.lit(False).alias("asks"))
        return asked.unionByName(held)

    def reached(self, queries: DataFrame, need: Need, counts: dict[str, int] | None = None, back: bool = False) -> DataFrame:
        """Of queries (chrom, idx, pos, cm, before), (chrom, idx, at): the nearest place that meets all minima, or the chromosome's end."""

        def find(t: pa.Table) -> pa.Table:
            chrom, asks = t["chrom"][0].as_py(), t["asks"].to_numpy()
            columns = [t[c].to_numpy() for c in ("idx", "pos", "cm", "upto")]
            asked = [x[asks] for x in columns]
            held = [x[~asks] for x in columns]
            order = np.argsort(held[0])
            here, own = Side.of(*(x[order] for x in held), back), _needed(need, counts, chrom)
            k = first_enough(here, Side.asking(*asked, back), own, own.common)  # none meets them: the end
            return _places(chrom, idx=asked[0], at=np.abs(here.idx[np.minimum(k, len(order) - 1)]))

        return self.dealt(queries, need, counts, back).groupBy("chrom", "source", "range").applyInArrow(find, "chrom string, idx long, at long")

    def opened(self, counts: dict[str, int], o: ChunkOptions) -> DataFrame:
        """WIN-07: (chrom, a, b) for the chromosomes of counts: the end of a window that opens at each place; a rest shorter than the buffer joins it."""
        some = self.rows.filter(F.col("chrom").isin(*counts))
        queries = some.select("chrom", "idx", "pos", "cm", (F.col("upto") - F.col("c")).alias("before"))
        found = self.reached(queries, Need(o.window_cm, o.window_mb * 1e6, 0, 1), counts)
        table = _small(some.sparkSession, [(c, int(r["idx"]), int(r["pos"]), float(r["cm"])) for c, r in self.last.items() if c in counts], chrom=TEXT, last=LONG, last_pos=LONG, last_cm=REAL)
        ends = some.select("chrom", F.col("idx").alias("at"), "pos", "cm")
        x = found.join(ends, ["chrom", "at"]).join(F.broadcast(table), "chrom")  # a row a chromosome
        rest = F.col("last") - F.col("at")
        short = (F.col("last_cm") - F.col("cm") < o.buffer_cm) | (F.col("last_pos") - F.col("pos") < o.buffer_mb * 1e6) | (rest < o.buffer_count)
        return x.select("chrom", F.col("idx").alias("a"), F.when((rest > 0) & short, F.col("last")).otherwise(F.col("at")).alias("b"))

    def chain(self, opened: DataFrame) -> DataFrame:
        """(chrom, a, b): the windows that follow one another from a chromosome's first site on.

        Within a range the way out of it is followed in one task; over ranges, pointers are doubled, so that rounds grow with
        the logarithm of the number of ranges; then the places where ranges are entered are marked, and windows listed from there.
        """
        per_range = self.per_range
        opened = cut_lineage(opened.withColumn("range", F.expr(f"a div {per_range}")))

        def out(t: pa.Table) -> pa.Table:
            a, order = t["a"].to_numpy(), np.argsort(t["a"].to_numpy())
            first, to = int(a.min()), (t["b"].to_numpy()[order] + 1).tolist()
            for i in range(len(to) - 1, -1, -1):
                if to[i] - first < len(to):
                    to[i] = to[to[i] - first]
            return _places(t["chrom"][0].as_py(), a=a[order], to=to)

        entries = opened.filter("a = 0").select("chrom", F.col("a").alias("entry"))
        if max(len(t) for t in self.ends.values()) > 1:
            jumps = [cut_lineage(opened.groupBy("chrom", "range").applyInArrow(out, "chrom string, a long, to long"))]
            while 1 << len(jumps) < max(len(t) for t in self.ends.values()):
                x = jumps[-1]
                x = x.join(x.select("chrom", F.col("a").alias("to"), F.col("to").alias("next")), ["chrom", "to"]).select("chrom", "a", F.col("next").alias("to"))
                jumps.append(cut_lineage(x))
            for j in reversed(jumps):
                both = F.array_compact(F.array("entry", "to"))
                entries = entries.join(j.withColumnRenamed("a", "entry"), ["chrom", "entry"], "left").select("chrom", F.explode(both).alias("entry"))
            entries = entries.join(opened.select("chrom", F.col("a").alias("entry")), ["chrom", "entry"], "left_semi")  # not beyond the end

        def walk(t: pa.Table) -> pa.Table:
            starts, ends, entry = (t[c].to_numpy() for c in ("a", "b", "entry"))
            rows: list[tuple[int, int]] = []
            if entry.any():
                order = np.argsort(starts[~entry])
                first, b, at = int(starts.min()), ends[~entry][order].tolist(), int(starts[entry].min())
                while at - first < len(b):
                    rows.append((at, b[at - first]))
                    at = rows[-1][1] + 1
            return _places(t["chrom"][0].as_py(), a=[a for a, _ in rows], b=[b for _, b in rows])

        marks = entries.select("chrom", F.expr(f"entry div {per_range}").alias("range"), F.col("entry").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(True).alias("entry"))
        both = marks.unionByName(_renewed(opened).select("chrom", "range", "a", "b", F.lit(False).alias("entry")))
        return both.groupBy("chrom", "range").applyInArrow(walk, "chrom string, a long, b long")

    def at(self, windows: DataFrame, **places) -> DataFrame:
        """windows with pos, cm, upto and c at some of its places, as columns like a_pos."""
        for name, place in places.items():
            here = self.rows.select("chrom", F.col("idx").alias(f"{name}_idx"), *(F.col(c).alias(f"{name}_{c}") for c in ("pos", "cm", "upto", "c")))
            windows = windows.withColumn(f"{name}_idx", place).join(here, ["chrom", f"{name}_idx"])
        return windows

    def halves(self, windows: DataFrame, o: ChunkOptions) -> DataFrame:
        """WIN-09: (chrom, a, b) halved, level by level, as long as both halves meet the minima; what can't be split is a window."""
        done: list[DataFrame] = []
        while True:
            x = self.at(windows, x=F.col("a"), m=F.expr("(a + b) div 2"), n=F.least(F.expr("(a + b) div 2 + 1"), F.col("b")), y=F.col("b"))
            left = F.col("m_upto") - F.col("x_upto") + F.col("x_c")
            right = F.col("y_upto") - F.col("m_upto")
            parts = (F.col("b") - F.col("a") >= 2) & (F.least(left, right) > o.window_count)
            for p, q in (("x", "m"), ("n", "y")):
                parts &= (F.col(f"{q}_cm") - F.col(f"{p}_cm") >= o.window_cm) & (F.col(f"{q}_pos") - F.col(f"{p}_pos") >= o.window_mb * 1e6)
            x = cut_lineage(x.select("chrom", "a", "b", F.col("m_idx").alias("m"), parts.alias("parts")))
            done.append(x.filter(~F.col("parts")).select("chrom", "a", "b"))
            if x.filter("parts").isEmpty():
                out = done[0]
                for d in done[1:]:
                    out = out.unionByName(d)
                return out
            two = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct((F.col("m") + 1).alias("a"), F.col("b").alias("b")))
            windows = x.filter("parts").select("chrom", F.explode(two).alias("w")).select("chrom", "w.a", "w.b")

    def whole(self, chroms: list[str]) -> DataFrame:
        """One window a chromosome."""
        return _small(self.rows.sparkSession, [(c, 0, int(self.last[c]["idx"])) for c in chroms], chrom=TEXT, a=LONG, b=LONG)


def sequential(p: Places, o: ChunkOptions) -> DataFrame:
    """WIN-08: windows with a growing count until the last of a chromosome is long enough, else halves. Each attempt is for the chromosomes that are left."""
    counts, done = dict.fromkeys(p.ends, o.window_count), []
    while counts:
        found = cut_lineage(p.chain(p.opened(counts, o)))
        last = found.groupBy("chrom").agg(F.count("*").alias("n"), F.max("a").alias("a"), F.max("b").alias("b"))
        last = p.at(last, x=F.col("a"), y=F.col("b"))
        long = (F.col("y_cm") - F.col("x_cm") >= o.window_cm) & (F.col("y_pos") - F.col("x_pos") >= o.window_mb * 1e6) & (F.col("b") - F.col("a") + 1 >= o.window_count)
        good = [r["chrom"] for r in last.filter((F.col("n") == 1) | long).select("chrom").collect()]  # a row a chromosome
        if good:
            done.append(found.filter(F.col("chrom").isin(*good)))
        counts = {c: n + 100 for c, n in counts.items() if c not in good}
        if over := [c for c, n in counts.items() if n > int(p.last[c]["idx"]) + 1]:
            done.append(p.halves(p.whole(over), o))
            counts = {c: n for c, n in counts.items() if c not in over}
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def even(p: Places, found: DataFrame, o: ChunkOptions) -> DataFrame:
    """WIN-12: windows of equal numbers of sites, as many as were found, for chromosomes where all such are long enough."""
    per = found.groupBy("chrom").agg(F.count("*").alias("windows"), (F.max("b") + 1).alias("n"))
    mean = F.ceil(F.col("n") / F.col("windows"))
    starts = per.filter("windows > 1").withColumn("mean", mean).withColumn("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("mean"))))
    again = p.at(starts.select("chrom", "a", (F.least(F.col("a") + F.col("mean"), F.col("n")) - 1).alias("b")), x=F.col("a"), y=F.col("b"))
    long = (F.col("y_cm") - F.col("x_cm") >= o.window_cm) & (F.col("y_pos") - F.col("x_pos") >= o.window_mb * 1e6)
    again = cut_lineage(again.select("chrom", "a", "b", long.alias("long")))
    kept = again.groupBy("chrom").agg(F.every("long").alias("all")).filter("all").select("chrom")
    return again.join(kept, "chrom").select("chrom", "a", "b").unionByName(found.join(kept, "chrom", "left_anti"))


#: Sites of a range: a task's share when windows are searched for.
PER_RANGE = 1 << 14


def chunk(sites: DataFrame, options: ChunkOptions = ChunkOptions(), lengths: dict[str, int] | None = None, per_range: int = PER_RANGE) -> DataFrame:
    """WIN-07 to WIN-12, AGG-15: windows of (chrom, pos, cm, is_common) with buffers; the first and last reach the chromosome's ends.

    cm must not fall along a chromosome (gmap.validate). All is dealt by ranges of places, none by chromosome.
    """
    o, known, spark = options, lengths or {}, sites.sparkSession
    p = Places(sites, per_range)
    if not p.ends:
        return spark.createDataFrame([], SCHEMA)
    if o.recursive:
        found = p.halves(p.whole(list(p.ends)), o)
    else:
        found = sequential(p, o)
        if o.uniform:
            found = even(p, found, o)
    found = cut_lineage(p.at(found, x=F.col("a"), y=F.col("b")))
    # WIN-10: on each side, the first site that meets all three minima
    need = Need(o.buffer_cm, o.buffer_mb * 1e6, o.buffer_count, floored=not o.exact_buffer)
    for name, side, back in (("lo", "x", True), ("hi", "y", False)):
        queries = found.select("chrom", *(F.col(f"{side}_{c}").alias(c) for c in ("idx", "pos", "cm")), F.lit(0).cast("long").alias("before"))
        reached = p.reached(queries, need, back=back).select("chrom", F.col("idx").alias(f"{side}_idx"), F.col("at").alias(f"{name}_at"))
        found = found.join(reached, ["chrom", f"{side}_idx"])
    found = p.at(found, lo=F.col("lo_at"), hi=F.col("hi_at"))
    bounds = _small(spark, [(c, int(r["idx"]), known.get(c, NO_LENGTH)) for c, r in p.last.items()], chrom=TEXT, last=LONG, length=LONG)
    found = found.join(F.broadcast(bounds), "chrom")  # a row a chromosome
    first, last = F.col("a") == 0, F.col("b") == F.col("last")
    return found.select(
        "chrom", (F.row_number().over(Window.partitionBy("chrom").orderBy("a")) - 1).alias("chunk"),  # a row a window
        F.when(first, F.lit(1)).otherwise(F.col("lo_pos")).cast("long").alias("buf_start"), F.when(last, F.col("length")).otherwise(F.col("hi_pos")).alias("buf_stop"),
        F.when(first, F.lit(1)).otherwise(F.col("x_pos")).cast("long").alias("core_start"), F.when(last, F.col("length")).otherwise(F.col("y_pos")).alias("core_stop"),
        (F.col("y_cm") - F.col("x_cm")).alias("cm"), (F.col("y_pos") - F.col("x_pos") + 1).alias("bp"), (F.col("b") - F.col("a") + 1).alias("n_variants"), (F.col("y_upto") - F.col("x_upto") + F.col("x_c")).alias("n_common"),
    )


def meet_halfway(chunks: DataFrame) -> DataFrame:
    """WIN-05, SNK-01: neighbouring cores meet at the middle of the gap between them."""
    w = Window.partitionBy("chrom").orderBy("chunk")
    after, before = F.lead("core_start").over(w), F.lag("core_stop").over(w)
    stop = F.when(after.isNull(), F.col("core_stop")).otherwise(F.floor((F.col("core_stop") + after) / 2))
    start = F.when(before.isNull(), F.col("core_start")).otherwise(F.floor((before + F.col("core_start")) / 2) + 1)
    return chunks.withColumns({"core_start": start.cast("long"), "core_stop": stop.cast("long")})


def as_lines(chunks: DataFrame) -> DataFrame:
    """SNK-01: the table's eight columns, tab separated."""
    def region(a: str, b: str):
        return F.concat(F.col("chrom"), F.lit(":"), F.col(a).cast("string"), F.lit("-"), F.col(b).cast("string"))

    columns = [F.col("chunk").cast("string"), F.col("chrom"), region("buf_start", "buf_stop"), region("core_start", "core_stop"), F.format_string("%g", "cm"), *(F.col(c).cast("string") for c in ("bp", "n_variants", "n_common"))]
    return chunks.select(F.concat_ws("\t", *columns).alias("value"))


def islands(values: DataFrame, order: str, value: str) -> DataFrame:
    """WIN-15: runs of equal values, as start, length and value."""
    x = previous(in_order(values, [order]), [order], before=value)
    x = x.withColumn("new", (~F.col(value).eqNullSafe(F.col("before"))).cast("int"))
    first = x.agg(F.min(order).alias("first_"))  # one row
    x = x.crossJoin(F.broadcast(first)).withColumn("new", F.when(F.col(order) == F.col("first_"), 1).otherwise(F.col("new"))).drop("first_", "before")
    x = running(x, [order], run=F.col("new")).withColumn("run", F.col("run") + F.col("new"))
    return x.groupBy("run").agg(F.min(order).alias("start"), F.count("*").alias("length"), F.first(value).alias(value)).drop("run")


def selection_groups(sites: DataFrame, modulo_cm: float) -> DataFrame:
    """WIN-06: groups of consecutive common, good sites by rounded genetic position; sites before the first such have none. Ranges in parallel."""
    good = F.col("is_common") & ~F.col("lq")
    kept = ranged(sites).withColumn("step", F.when(good, F.round(F.col("cm") / F.lit(float(modulo_cm))).cast("long")))
    key = [*range_keys(sites), RANGE]
    over = (Window.partitionBy(*key[:-1]) if key[:-1] else Window.partitionBy(F.lit(0))).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    ends = kept.groupBy(*key).agg(F.max_by("step", F.when(F.col("step").isNotNull(), F.struct("pos", "site"))).alias("end"))  # a row a range
    carried = ends.select(*key, F.last("end", True).over(over).alias("carried"))
    kept = kept.join(carried, key, "left")
    w = within(kept).orderBy("pos", "site")
    last = F.coalesce(F.last("step", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("carried"))
    kept = kept.withColumn("change", (F.col("step").isNotNull() & (last.isNull() | (last != F.col("step")))).cast("int"))
    kept = with_totals_before(kept, changes=F.col("change"))
    return kept.withColumn("grp", F.when(good, F.col("changes") + F.sum("change").over(w) - 1)).drop("step", "change", "changes", "carried", RANGE)
