"""License scans by template markup.

A template is a license's wording with marked regions:

    plain words          mandatory, in this order
    [[ ... ]]            optional; may hold any markup
    {{name:m-n}}         replaceable: any m to n words ({{name:n}}: exactly n)

Each template compiles into a token automaton.  A text is accepted where the
automaton, started at a word, reaches its end: every mandatory word is there,
nothing else stands outside the marked regions.  Words are lower-cased (A-Z) runs
of ASCII letters, digits and non-ASCII characters, so punctuation and line
breaks never matter.  The base phrases are templates without regions.

The words of a batch of documents are hashed at once.  A template starts with
mandatory words, so an automaton is started only where these stand, and reads at
most its longest wording from there.  One pass over the table, no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import table
from tessera.llm.hashing import CHUNK, string_buffers, word_hashes, word_spans

# The base phrases and their labels.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)

# Grant statements, file notices and permission texts of public licenses.
TEMPLATES = (
    ("apache-grant", "licensed under the [[terms of the]] Apache License [[,]] version 2.0"),
    ("apache-notice", "licensed under the Apache License Version 2.0 the License you may not use {{what:1-4}} except in compliance "
                      "with the License you may obtain a copy of the License at"),
    ("bsd-terms", "redistribution and use [[of {{what:1-4}}]] in source and binary forms with or without modification are permitted "
                  "provided that the following conditions are met"),
    ("cc-by-grant", "licensed under [[a]] [[the]] [[Creative Commons]] CC BY [[NC]] [[SA]] [[ND]] {{version:2}}"),
    ("cc-by-grant", "licensed under [[a]] [[the]] Creative Commons Attribution [[NonCommercial]] [[ShareAlike]] [[NoDerivatives]] "
                    "{{version:2}} {{scope:0-2}} license"),
    ("gpl-grant", "licensed under the [[terms of the]] GNU General Public License [[as published by the Free Software Foundation]] "
                  "[[either]] version {{number:1}}"),
    ("gpl-notice", "is free software you can redistribute it and or modify it under the terms of the GNU General Public License "
                   "as published by the Free Software Foundation [[either]] version {{number:1}}"),
    ("isc-permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit-grant", "licensed under the [[terms of the]] MIT license"),
    ("mit-grant", "released under the [[terms of the]] MIT license"),
    ("mit-permission", "permission is hereby granted free of charge to any person obtaining a copy of {{what:1-12}} to deal in "
                       "{{what:1-4}} without restriction including without limitation the rights to use copy modify merge publish "
                       "distribute sublicense and or sell copies of {{what:1-4}}"),
    ("spdx-tag", "SPDX License Identifier {{id:1}}"),
)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Byte by byte: letters and digits lower-cased, other ASCII a space.
_WORDS = np.where((np.arange(256) >= 128) | np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123)]),
                  _LOWER, 32).astype(np.uint8)
_MARK = re.compile(r"\[\[|\]\]|\{\{[^{}:]*:(\d+)(?:-(\d+))?\}\}|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

OTHER = -1


def _hash_words(text: str) -> list[int]:
    buf = _WORDS[np.frombuffer(text.encode(), np.uint8)]
    starts, ends = word_spans(buf, np.zeros(1, np.int64))
    return word_hashes(buf, starts, ends).tolist()


@dataclass
class TokenAutomaton:
    """edges[state]: (word hash or None for any word, next state); skips[state]:
    states reached without a word.  The last state accepts."""
    label: str
    base: bool
    head: list[int] = field(default_factory=list)  # the words it starts with
    edges: list[list[tuple[int | None, int]]] = field(default_factory=lambda: [[]])
    skips: list[list[int]] = field(default_factory=lambda: [[]])
    known: dict = field(default_factory=dict)

    def grow(self, word: int | None) -> int:
        self.edges[-1].append((word, len(self.edges)))
        self.edges.append([])
        self.skips.append([])
        return len(self.edges) - 1

    @property
    def longest(self) -> int:
        return len(self.edges) - 1

    def closure(self, states) -> frozenset[int]:
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                todo.extend(self.skips[s])
        return frozenset(out)

    def step(self, states: frozenset[int], word: int) -> frozenset[int]:
        """States after one more word; remembered, words outside the template as one."""
        key = (states, word if word in self.words else OTHER)
        out = self.known.get(key)
        if out is None:
            if len(self.known) > 20_000:
                self.known.clear()
            out = self.closure(t for s in states for w, t in self.edges[s] if w is None or w == word)
            self.known[key] = out
        return out

    def accepts(self, words: list[int]) -> int | None:
        """Words of the shortest accepted beginning of ``words``, else None."""
        states, last = self.closure([0]), self.longest
        for n, word in enumerate(words):
            states = self.step(states, word)
            if not states:
                return None
            if last in states:
                return n + 1
        return None

    def finish(self) -> TokenAutomaton:
        self.words = {w for out in self.edges for w, _ in out if w is not None}
        return self


def compile_template(label: str, markup: str, base: bool = False) -> TokenAutomaton:
    """The automaton of one template.  It must start with a mandatory word."""
    auto, opened, plain = TokenAutomaton(label, base), [], True
    for mark in _MARK.finditer(markup.lower()):
        piece = mark.group()
        if piece == "[[":
            opened.append(len(auto.edges) - 1)
            plain = False
        elif piece == "]]":
            if not opened:
                raise ValueError(f"{label}: ]] without [[")
            auto.skips[opened.pop()].append(len(auto.edges) - 1)
        elif mark.group(1):
            least, most = int(mark.group(1)), int(mark.group(2) or mark.group(1))
            begun = [auto.grow(None) if i else len(auto.edges) - 1 for i in range(most + 1)]
            for s in begun[least:-1]:
                auto.skips[s].append(begun[-1])
            plain = False
        else:
            for word in _hash_words(piece):
                auto.grow(word)
                if plain:
                    auto.head.append(word)
    if opened or not auto.head:
        raise ValueError(f"{label}: " + ("[[ without ]]" if opened else "does not start with a mandatory word"))
    return auto.finish()


def automata(templates=TEMPLATES, phrases=PHRASES) -> list[TokenAutomaton]:
    return ([compile_template(label, text, base=True) for label, text in phrases]
            + [compile_template(label, text) for label, text in templates])


def _places(words: np.ndarray, last: np.ndarray, auto: TokenAutomaton) -> list[tuple[int, int]]:
    """(start, end) of every accepted place in the words of a chunk; last: for
    each word the end of its document."""
    n = len(words) - len(auto.head) + 1
    if n <= 0:
        return []
    at = np.flatnonzero(words[:n] == np.uint64(auto.head[0]))
    for k, word in enumerate(auto.head[1:], 1):
        at = at[words[at + k] == np.uint64(word)]
    out = []
    for i in at[at + len(auto.head) <= last[at]].tolist():
        size = auto.longest if len(auto.head) == auto.longest else auto.accepts(words[i:min(i + auto.longest, last[i])].tolist())
        if size is not None:
            out.append((i, i + size))
    return out


_PLACE = T.StructType([T.StructField("label", T.StringType()), T.StructField("base", T.BooleanType()),
                       T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])


def scan_licenses(spark: SparkSession, docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Every place of ``docs.text`` that a template or phrase accepts.

    docs: text and any other columns.  Returns all of them plus ``license``
    struct<n_words long, places array<struct<label, base, start, stop>>>: words
    from 0, stop exclusive, in order of start, stop, label; base: from a phrase.
    A column of that name in docs is replaced.  A null or empty text has no words
    and no places; rows that repeat are scanned one by one; an empty table gives
    no rows.  Documents are read whole; a chunk of a batch is a megabyte or one
    longer document."""
    rest = [c for c in docs.columns if c != "license"]
    shapes = [(label, text, True) for label, text in phrases] + [(label, text, False) for label, text in templates]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [compile_template(*shape) for shape in shapes]
        for batch in batches:
            counts, found = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            data, off = string_buffers(batch.column(1))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + CHUNK, "right")) - 1)
                buf, cuts = _WORDS[data[off[lo]:off[hi]]], off[lo:hi] - off[lo]
                starts, ends = word_spans(buf, cuts)
                words = word_hashes(buf, starts, ends)
                first = np.append(np.searchsorted(starts, cuts), len(starts))
                counts[lo:hi] = np.diff(first)
                last = np.repeat(first[1:], np.diff(first))
                for auto in compiled:
                    for a, b in _places(words, last, auto):
                        d = int(np.searchsorted(first, a, "right")) - 1
                        found[lo + d].append((a - int(first[d]), b - int(first[d]), auto.label, auto.base))
                lo = hi
            value = [{"n_words": int(n), "places": [{"label": x[2], "base": x[3], "start": x[0], "stop": x[1]} for x in sorted(p)]}
                     for n, p in zip(counts, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, out_type)], names=["row", "license"])

    out_type = pa.struct([("n_words", pa.int64()), ("places", pa.list_(pa.struct(
        [("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("stop", pa.int64())])))])
    inp = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.coalesce("text", F.lit("")).alias("body"))
    schema = T.StructType([inp.schema["row"], T.StructField("license", T.StructType(
        [T.StructField("n_words", T.LongType()), T.StructField("places", T.ArrayType(_PLACE))]))])
    return inp.mapInArrow(scan, schema).select(*[F.col("row")[c].alias(c) for c in rest], "license")


def op13_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score: 1 - 2^-(base labels) * 4^-(template labels); 0 without any."""
    out = scan_licenses(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    places = F.col("license.places")
    base = F.filter(places, lambda p: p["base"])
    names = lambda of: F.sort_array(F.array_distinct(F.transform(of, lambda p: p["label"])))
    own = names(F.filter(places, lambda p: ~p["base"]))
    return out.select("doc_id", F.col("license.n_words").alias("n_words"), F.size(base).cast("long").alias("n_base"),
                      F.array_min(F.transform(base, lambda p: p["start"])).alias("first_word"),
                      F.array_max(F.transform(base, lambda p: p["start"])).alias("last_word"),
                      F.array_join(names(base), ",").alias("base_labels"), F.array_join(names(places), ",").alias("labels"),
                      (1 - F.pow(F.lit(0.5), F.size(names(base))) * F.pow(F.lit(0.25), F.size(own))).alias("score"))


def _phrase_sql(text: str) -> str:
    words = text.split()
    return (f"list_filter(range(0, len(w) - {len(words) - 1}), lambda i: "
            + " and ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(words)) + ")")


def _template_pattern(markup: str) -> str:
    """The template as a pattern over words that each end in a space."""
    out = ""
    for m in _MARK.finditer(markup.lower()):
        if m.group() == "[[":
            out += "(?:"
        elif m.group() == "]]":
            out += ")?"
        elif m.group(1):
            out += f"(?:[^ ]+ ){{{m.group(1)},{m.group(2) or m.group(1)}}}"
        else:
            out += m.group() + " "
    return " " + out


def _labels_sql() -> str:
    named: dict[str, list[str]] = {}
    for label, text in TEMPLATES:
        named.setdefault(label, []).append(f"regexp_matches(t, '{_template_pattern(text)}')")
    return "list_filter([" + ", ".join(f"case when {' or '.join(v)} then '{k}' end" for k, v in named.items()) + "], lambda x: x is not null)"


OP13_SQL = rf"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
p as (select doc_id, w, ' ' || array_to_string(w, ' ') || ' ' as t, {', '.join(f"{_phrase_sql(text)} as p{n}" for n, (_, text) in enumerate(PHRASES))} from d),
b as (select doc_id, len(w) as n_words, {' || '.join(f'p{n}' for n in range(len(PHRASES)))} as places,
             list_filter([{', '.join(f"case when len(p{n}) > 0 then '{label}' end" for n, (label, _) in enumerate(PHRASES))}], lambda x: x is not null) as base,
             {_labels_sql()} as own from p)
select doc_id, n_words, len(places) as n_base, list_min(places) as first_word, list_max(places) as last_word,
       array_to_string(list_sort(base), ',') as base_labels, array_to_string(list_sort(list_distinct(base || own)), ',') as labels,
       1 - power(0.5, len(base)) * power(0.25, len(own)) as score
from b
"""
