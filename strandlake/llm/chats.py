r"""Operator 11: reply trees formatted as conversations.

Messages reply to messages, so they form trees. Iterative self-joins walk all nodes to their roots, twice as far in each
round, and add up scores on the way; the branches of a tree (its leaves) are ranked by the score of their whole path;
and self-joins along the kept links, from the longest to the shortest, enumerate the paths of chosen leaves, each node once.
Rounds grow with the logarithm of a tree's depth, rows with the sum of the paths' lengths.

Each chosen path is formatted as one conversation: `<s>`, then for every turn `<|turn|>role<|text|>text</s>`. Control
strings in roles and texts (the template's own and those of other templates) get a backslash after their first
character, and those that have backslashes there get one more, so escaping can be undone exactly and no control string of a text is one in
the output. The loss mask is a list of runs of code points that cover the output; it is on in the texts of trained roles.

Turns are formatted row by row and put together in pieces of PIECE turns before a conversation becomes one row, so that
a long conversation isn't gathered turn by turn.

Defined results: a null text or role is empty; equal ids are one message, the least by parent, role, text and score; a
parent that isn't there makes a root; a message without an id is left out; messages on or below a cycle have no root and no path; ties between branches go to the
smaller leaf; a null score counts as 0; `threads` orders rows of one conversation and turn by role and text, null first,
and repeated rows are turns each; a null conv_id is a conversation of its own; an empty table gives an
empty result; a very long text is escaped whole (a conversation must fit one Spark value, 2 GB); other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .sharding import ranged, running

#: Turns put together at a time.
PIECE = 64
#: Stands in for a null id.
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Template:
    """Marks of a conversation, of a turn, of its text and of its end; the roles that are trained; what is escaped."""

    opening: str = "<s>"
    turn: str = "<|turn|>"
    text: str = "<|text|>"
    end: str = "</s>"
    trained: tuple[str, ...] = ("assistant",)
    #: Control strings of common templates beside its own. None may hold another or begin as another ends.
    others: tuple[str, ...] = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<unk>", "<pad>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>")

    @property
    def marks(self) -> list[str]:
        return sorted({self.opening, self.turn, self.text, self.end, *self.others} - {""})

    def by_first(self) -> dict[str, str]:
        """First characters of control strings, each with a pattern of what may follow."""
        found: dict[str, list[str]] = {}
        for m in self.marks:
            found.setdefault(m[0], []).append(re.escape(m[1:]))
        return {c: "|".join(rest) for c, rest in sorted(found.items())}

    def pattern(self, count: str) -> str:
        """Control strings with `count` (* or +) backslashes after their first character."""
        return "|".join(f"{re.escape(c)}\\\\{count}(?:{rest})" for c, rest in self.by_first().items())

    def escape(self, text: str) -> str:
        return re.sub(self.pattern("*"), lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return re.sub(self.pattern("+"), lambda m: m[0][0] + m[0][2:], text)

    def escaped(self, column: Column) -> Column:
        for c, rest in self.by_first().items():
            column = F.regexp_replace(column, F.lit(f"{re.escape(c)}(\\\\*(?:{rest}))"), F.lit(c + "\\\\$1"))
        return column


# trees ----------------------------------------------------------------------------------------------------


def walked(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """For nodes (node, parent, score): (node, root, depth, total) and, for each k, the links (node, up) over 2**k parents."""
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    linked = nodes.filter(F.col("parent").isNotNull()).join(known, "parent", "left").select("node", F.when(F.col("there"), F.col("parent")).alias("up"), "score")
    roots = nodes.filter(F.col("parent").isNull()).select("node", F.lit(None).cast("long").alias("up"), "score")
    at = linked.unionByName(roots).select("node", "up", F.col("node").alias("root"), F.lit(1).cast("long").alias("depth"), "score")
    links: list[DataFrame] = []
    while True:
        at = common.cut_lineage(at)
        climbing, there = at.filter(F.col("up").isNotNull()), at.filter(F.col("up").isNull())
        n = at.agg(F.count("*").alias("all"), F.count("up").alias("climbing")).first()
        if not n["climbing"] or 1 << len(links) > n["all"]:  # what climbs on is on a cycle
            return there.select("node", "root", "depth", F.col("score").alias("total")), links
        links.append(climbing.select("node", "up"))
        further = at.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("root").alias("top"), F.col("depth").alias("more"), F.col("score").alias("gain"))
        moved = climbing.join(further, "up").select("node", F.col("next").alias("up"), F.col("top").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("score") + F.col("gain")).alias("score"))
        at = moved.unionByName(there)  # rows without a parent take no part in the join: they would have one key


def branches(nodes: DataFrame, top: DataFrame, keep: int | None) -> DataFrame:
    """Leaves (node, root, depth, total, rank) of every tree, the best `keep` by the score of their path."""
    leaves = top.join(nodes.select(F.col("parent").alias("node")).filter(F.col("node").isNotNull()).distinct(), "node", "left_anti")
    if keep is None:
        return leaves
    order = Window.partitionBy("root").orderBy(F.desc("total"), "node")
    return leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)  # cut in tasks before the shuffle


def paths(messages: DataFrame, keep: int | None = 1, unique: bool = False) -> DataFrame:
    """Root-to-leaf paths of messages (node, parent, role, text, score): (root, leaf, place, role, text), place from 0.

    `unique` says that ids are known to differ, which saves a shuffle of the texts.
    """
    one = messages
    if not unique:
        first = F.min(F.struct("parent", "role", "text", "score")).alias("m")
        one = common.cut_lineage(messages.filter(F.col("node").isNotNull()).groupBy(F.col("node").cast("long").alias("node")).agg(first).select("node", "m.*"))
    nodes = one.select("node", F.col("parent").cast("long").alias("parent"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    top, links = walked(nodes)
    chosen = branches(nodes, top, keep)
    steps = chosen.select("root", F.col("node").alias("leaf"), "node", (F.col("depth") - 1).alias("place"))
    for k in range(len(links) - 1, -1, -1):
        both = F.array_compact(F.array(F.struct("node", "place"), F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("node"), (F.col("place") - F.lit(1 << k)).alias("place")))))
        steps = steps.join(links[k], "node", "left").select("root", "leaf", F.explode(both).alias("at")).select("root", "leaf", "at.*")
    return steps.join(one.select("node", "role", "text"), "node").select("root", "leaf", "place", "role", "text")


def threads(conversations: DataFrame) -> DataFrame:
    """Messages of conversations (conv_id, turn, role, text) as trees: every row replies to the one before it. With conv_id.

    Rows are ranked by ranges of the whole order, so that no conversation is one task.
    """
    rows = conversations.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(NO_ID)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    rows = ranged(rows, order, common.partitions(conversations.sparkSession))
    # the first row of a conversation: in a range by the window, across ranges by the last row of the range before
    before = Window.partitionBy("range").orderBy(*order)
    rows = running(rows.withColumn("before", F.lag("conv_id").over(before)), order, {"node": F.lit(1).cast("long")})
    lasts = rows.groupBy("range").agg(F.max("conv_id").alias("last"))  # a row a range
    lasts = lasts.select(F.lead("range").over(Window.orderBy("range")).alias("range"), "last")
    rows = rows.join(lasts, "range", "left").withColumn("before", F.coalesce("before", "last"))
    parent = F.when(F.col("before") == F.col("conv_id"), F.col("node") - 1)
    return rows.select("conv_id", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


# conversations --------------------------------------------------------------------------------------------


def formatted(steps: DataFrame, template: Template | None = None) -> DataFrame:
    """Of paths (root, leaf, place, role, text): root, leaf, formatted, mask (array of (chars, loss)), one row a path."""
    t = template or Template()
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    lead = F.concat(F.lit(t.turn), t.escaped(role), F.lit(t.text))
    turns = steps.select("root", "leaf", "place", lead.alias("lead"), t.escaped(text).alias("body"), role.isin(*t.trained).alias("loss"))
    run = lambda n, on: F.struct(n.cast("int").alias("chars"), on.alias("loss"))
    runs = F.array(run(F.length("lead"), F.lit(False)), run(F.length("body"), F.col("loss")), run(F.lit(len(t.end)), F.lit(False)))
    turns = turns.select("root", "leaf", "place", F.concat("lead", "body", F.lit(t.end)).alias("piece"), runs.alias("runs"))

    def together(df: DataFrame, by: Column, place: str) -> DataFrame:
        """Pieces in order of place, put together by root, leaf and `by`."""
        held = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), "piece", "runs")))
        df = df.groupBy("root", "leaf", by.alias("part")).agg(held.alias("held"))
        return df.select("root", "leaf", "part", F.array_join("held.piece", "").alias("piece"), F.flatten("held.runs").alias("runs"))

    pieces = together(turns, F.expr(f"place div {PIECE}"), "place")
    whole = together(pieces, F.lit(0), "part")
    opening = F.array(run(F.lit(len(t.opening)), F.lit(False)))
    return whole.select("root", "leaf", F.concat(F.lit(t.opening), "piece").alias("formatted"), F.concat(opening, "runs").alias("mask"))


def read_back(text: str, template: Template) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    if not text.startswith(template.opening):
        raise ValueError("not a formatted conversation")
    out = []
    for turn in text[len(template.opening) :].split(template.end)[:-1]:
        if not turn.startswith(template.turn):
            raise ValueError("not a turn")
        role, body = turn[len(template.turn) :].split(template.text)
        out.append((template.unescape(role), template.unescape(body)))
    return out


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(text: str, mask: list[tuple[int, bool]], template: Template) -> tuple:
    """What the output holds, by reading it: turns by its marks, trained texts by the mask alone."""
    sha, n = hashlib.sha256(), 0
    for role, body in read_back(text, template):
        sha.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
        n += 1
    at, chars, loss = 0, 0, hashlib.sha256()
    for length, on in mask:
        if on:
            body = template.unescape(text[at : at + length])
            chars += len(body)
            loss.update(common.as_bytes(body))
        at += length
    if at != len(text):
        raise ValueError("the mask doesn't cover the text")
    return n, sha.hexdigest(), chars, loss.hexdigest(), len(text)


def digests(conversations: DataFrame, key: str, template: Template | None = None) -> DataFrame:
    """Of formatted conversations (key, formatted, mask): key and the digests of what is read back from them."""
    t = template or Template()
    common.bounded_batches(conversations.sparkSession)

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, text, mask in zip(*(batch.column(i) for i in range(3)), strict=True):
                runs = mask.values
                rows.append((k.as_py(), *digest(text.as_py(), list(zip(runs.field("chars").to_pylist(), runs.field("loss").to_pylist(), strict=True)), t)))
            if rows:
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(zip(*rows, strict=True), types, strict=True)], names=[key, *(x.split()[0] for x in DIGESTS.split(", "))])

    return conversations.select(key, "formatted", "mask").mapInArrow(process, f"{key} long, {DIGESTS}")


def chats(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """Conversations (conv_id, turn, role, text) formatted: conv_id, formatted, mask."""
    messages = common.cut_lineage(threads(conversations))
    out = formatted(paths(messages.drop("conv_id"), unique=True), template)
    ids = messages.filter(F.col("parent").isNull()).select(F.col("node").alias("root"), F.nullif("conv_id", F.lit(NO_ID)).alias("conv_id"))
    return out.join(ids, "root").select("conv_id", "formatted", "mask")


#: A conversation of control strings that is formatted with the others.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def with_planted(conversations: DataFrame) -> DataFrame:
    """The table and conversation -7."""
    planted = conversations.sparkSession.createDataFrame(PLANTED, "conv_id long, turn long, role string, text string")
    return conversations.select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string")))).unionByName(planted)


def oracle(template: Template | None = None) -> str:
    """DuckDB SQL for the digests of formatted conversations."""
    t = template or Template()

    def escaped(column: str) -> str:
        for c, rest in t.by_first().items():
            column = rf"regexp_replace({column}, '{re.escape(c)}(\\*(?:{rest}))', '{c}\\\1', 'g')"
        return column

    planted = ", ".join(f"({i}, {n}, '{r}', '{x}')" for i, n, r, x in PLANTED)
    trained = ", ".join(f"'{r}'" for r in t.trained)
    own = len(t.turn) + len(t.text) + len(t.end)
    return rf"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES {planted}))
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role COLLATE "binary", text COLLATE "binary")) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role IN ({trained})), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role COLLATE "binary", text COLLATE "binary") FILTER (WHERE role IN ({trained})), '')) AS loss_sha256,
       ({len(t.opening)} + sum({own} + length({escaped("role")}) + length({escaped("text")})))::BIGINT AS formatted_chars
FROM every GROUP BY conv_id
"""
