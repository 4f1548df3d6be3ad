"""Operator 9: license texts found by templates with optional and replaceable regions.

A template is written in markup: plain words are mandatory, `<<opt>> ... <<end>>` may be absent, and
`<<var;n>>` stands for up to n words of any kind. It is compiled into an automaton over words, which
accepts a text that contains the mandatory words exactly, in order. The automaton is started only
where the template's opening words stand; those places are found by a search over the joined words.
Plain phrases (the base) are counted at all places.

Words are the maximal runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lower-cased. Score: with m
the most mandatory words of an accepted template or found phrase, m / (m + 1), else 0.

Defined results: null and empty texts have 0 words, no labels (empty strings) and score 0; repeated
rows are scored each; ties don't matter; very long texts are searched whole; an empty table gives an empty result; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Public license wordings as templates, and their labels.
TEMPLATES = [
    ("mit-notice", "<<opt>>this software is<<end>> released under the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<opt>>the software<<end>> to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software"),
    ("apache-2-notice", "licensed under the apache license version 2 0 <<opt>>the license<<end>>"),
    ("apache-2-header", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<var;8>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl-3", "licensed under the <<opt>>terms of the<<end>> gnu general public license <<opt>>as published by the free software foundation either<<end>> <<opt>>gpl<<end>> version 3"),
    ("gpl-2", "licensed under the <<opt>>terms of the<<end>> gnu general public license <<opt>>as published by the free software foundation either<<end>> <<opt>>gpl<<end>> version 2"),
    ("lgpl-2.1", "gnu lesser general public license <<opt>>as published by the free software foundation either<<end>> version 2 1"),
    ("cc-by-nc-4.0", "licensed under <<opt>>a creative commons<<end>> cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under <<opt>>a creative commons<<end>> cc by sa 4 0"),
    ("cc-by-4.0", "licensed under <<opt>>a creative commons<<end>> cc by 4 0"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution <<opt>>3<<end>> neither the name of <<var;12>> may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph <<opt>>and the following two paragraphs<<end>> appear in all copies"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software"),
    ("gpl-2.0-or-later", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("epl-2.0", "made available under the terms of the eclipse public license <<opt>>v<<end>> <<opt>>version<<end>> 2 0"),
    ("cc0-1.0", "to the extent possible under law <<var;12>> waived all copyright and related or neighboring rights to"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nd-4.0", "licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

#: Bytes that end a word; 0-9, a-z and all beyond ASCII are part of words.
GAPS = common.separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
CLEAN = bytes(0x20 if GAPS[common.LOWER[c]] else common.LOWER[c] for c in range(256))

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,stop:long>>"
NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
TYPES = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))]


def parse(markup: str) -> list:
    """Words, ("var", n) and nested lists (optional regions)."""
    stack: list[list] = [[]]
    for part in re.findall(r"<<[^>]*>>|[^\s<]+", markup):
        if part == "<<opt>>":
            stack.append([])
        elif part == "<<end>>":
            done = stack.pop()
            stack[-1].append(done)
        elif part.startswith("<<var"):
            stack[-1].append(("var", int(part.split(";")[1].rstrip(">"))))
        else:
            stack[-1].append(part.encode())
    if len(stack) != 1:
        raise ValueError(f"unbalanced template: {markup}")
    return stack[0]


@dataclass
class Automaton:
    """Word automaton: moves[state] maps a word to the next state, or None as key for any word."""

    label: str
    opening: bytes
    mandatory: int
    moves: list[dict]
    silent: list[list[int]]
    final: int

    @classmethod
    def build(cls, label: str, markup: str) -> Automaton:
        tree = parse(markup)
        while isinstance(tree[0], list):  # an optional opening adds nothing to acceptance
            tree = tree[1:]
        opening = []
        for x in tree:
            if not isinstance(x, bytes):
                break
            opening.append(x)
        moves: list[dict] = [{}]
        silent: list[list[int]] = [[]]

        def state() -> int:
            moves.append({})
            silent.append([])
            return len(moves) - 1

        def add(items: list, at: int) -> int:
            for x in items:
                if isinstance(x, list):
                    end = state()
                    silent[at].append(end)
                    silent[add(x, at_inner := state())].append(end)
                    silent[at].append(at_inner)
                    at = end
                elif isinstance(x, tuple):
                    end = state()
                    silent[at].append(end)
                    for _ in range(x[1]):
                        nxt = state()
                        moves[at][None] = nxt
                        silent[nxt].append(end)
                        at = nxt
                    at = end
                else:
                    nxt = state()
                    moves[at][x] = nxt
                    at = nxt
            return at

        final = add(tree, 0)
        return cls(label, b" ".join(opening), sum(isinstance(x, bytes) for x in tree), moves, silent, final)

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.silent[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def run(self, words: list[bytes], at: int) -> int:
        """The shortest accepted run from word `at`: its end, or -1."""
        states = self._closed({0})
        while self.final not in states:
            if at >= len(words) or not states:
                return -1
            states = self._closed({m[k] for s in states for m in (self.moves[s],) for k in (words[at], None) if k in m})
            at += 1
        return at


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word positions of a phrase in words joined (and enclosed) by spaces."""
    found, needle, at, seen, word = [], b" " + phrase + b" ", joined.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        word += joined.count(b" ", seen, at)
        seen = at
        found.append(word)
        at = joined.find(needle, at + 1)
    return found


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: list[tuple[str, str]]):
        self.phrases = [(p.encode(), p.count(" ") + 1, label) for p, label in phrases.items()]
        self.automata = [Automaton.build(*t) for t in templates]

    def scan(self, text: str | None) -> tuple:
        words = common.as_bytes(text).translate(CLEAN).split()
        joined = b" " + b" ".join(words) + b" "
        starts, base, spans, best = [], set(), [], 0
        for phrase, n, label in self.phrases:
            if found := places(joined, phrase):
                starts += found
                base.add(label)
                best = max(best, n)
                spans += [(label, i, i + n) for i in found]
        labels = set(base)
        known: dict[bytes, list[int]] = {}
        for a in self.automata:
            if a.opening not in known:
                known[a.opening] = places(joined, a.opening)
            for i in known[a.opening]:
                if (end := a.run(words, i)) >= 0:
                    labels.add(a.label)
                    best = max(best, a.mandatory)
                    spans.append((a.label, i, end))
        return (
            len(words), len(starts), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), best / (best + 1), [{"label": x, "start": s, "stop": e} for x, s, e in spans],
        )


def licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document: counts and places of phrases, labels of phrases and templates, spans in words."""
    common.bounded_batches(docs.sparkSession)
    base, marked = phrases or PHRASES, templates or TEMPLATES

    def process(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, marked)
        for batch in batches:
            rows = [(i, *scanner.scan(t)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=NAMES)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(process, SCHEMA)


def pattern(markup: str) -> str:
    """The regular expression, over words enclosed by single spaces, of what a template accepts."""

    def piece(items: list) -> str:
        out = ""
        for x in items:
            out += f"(?:{piece(x)})?" if isinstance(x, list) else f"(?: [^ ]+){{0,{x[1]}}}" if isinstance(x, tuple) else " " + re.escape(x.decode())
        return out

    tree = parse(markup)
    while isinstance(tree[0], list):
        tree = tree[1:]
    return piece(tree) + " "


def oracle(phrases: dict[str, str] | None = None, templates: list[tuple[str, str]] | None = None) -> str:
    """DuckDB SQL for the result without spans."""
    base, marked = phrases or PHRASES, templates or TEMPLATES
    starts = " UNION ALL ".join(
        f"SELECT doc_id, rid, i, '{label}' AS label, {p.count(' ') + 1} AS m FROM places WHERE array_to_string(ws[i : i + {p.count(' ')}], ' ') = '{p}'" for p, label in base.items()
    )
    own = " UNION ALL ".join(
        f"SELECT rid, '{label}' AS label, {Automaton.build(label, t).mandatory} AS m FROM joined WHERE regexp_matches(j, '{pattern(t)}')" for label, t in marked
    )
    return rf"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
places AS (SELECT doc_id, rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
starts AS ({starts}),
base AS (SELECT rid, count(*) AS n, min(i) - 1 AS f, max(i) - 1 AS l, max(m) AS m, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM starts GROUP BY rid),
joined AS (SELECT rid, ' ' || array_to_string(ws, ' ') || ' ' AS j FROM words),
own AS ({own}),
everything AS (SELECT rid, label, m FROM own UNION ALL SELECT rid, label, m FROM starts),
best AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(m) AS m FROM everything GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.f::BIGINT AS first_word, b.l::BIGINT AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(t.labels, '') AS labels, coalesce(t.m, 0)::DOUBLE / (coalesce(t.m, 0) + 1) AS score
FROM words LEFT JOIN base b USING (rid) LEFT JOIN best t USING (rid)
"""
