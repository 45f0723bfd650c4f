"""License scans: an exact set-similarity join of text blocks with licence templates.

A block is a line of a text, or if paragraphs are asked for also one: a run of lines that all have
tokens (so lines of comment marks alone end it). In a paragraph the match is the
run of lines, of at most twice the template's words, that shares most with it (of
equals that of the fewest words, then the first); it is reported by that run's
first line, for the templates that none of the paragraph's lines matches alone.
Tokens are the distinct ``[a-z0-9]+`` of the
lower-cased block or template. A block matches a template if it holds at least
the share threshold of the template's tokens; every such pair is found.

Tokens are put in one global order, the rarest first, by the number of blocks
of the whole corpus that hold them. With need = ceil(threshold * |template|)
a match implies:

* prefix: some token among the template's first |template| - need + 1 is among
  the block's first |block| - need + 1;
* length: the block has at least need tokens;
* positions: the common token at places i and j leaves at most
  min(|template| - i, |block| - j) common tokens, which must reach need.

Only tokens of templates can be shared, so blocks are cut down to these first;
sizes and places in the cut-down blocks keep the bounds exact. What passes is
verified on the tokens themselves. Templates are a fixed list and go to every
task; texts are never shuffled.

Cases: null and empty texts have no blocks. Repeated rows, and equal blocks of
a text, each give their matches. Ties in frequency are ordered by the token. A
template without tokens never matches. Null doc_ids are reported as such. Very
long texts and lines are scanned whole. An empty table gives no rows. Extra
columns, whatever their names, play no part.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from . import lexical
from .frames import narrow, per_batch, summed_arrays

THRESHOLD = 0.8
TOKEN = re.compile("[a-z0-9]+")

TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-notice": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "agpl-notice": "Licensed under the GNU Affero General Public License, version 3.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0-notice": "Licensed under the Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def tokens(text: str) -> list[str]:
    """Distinct tokens in the order in which they appear."""
    return list(dict.fromkeys(TOKEN.findall(text.lower())))


class Blocks:
    """The lines of some texts, and for each of their tokens its place in a sorted list of known hashes."""

    def __init__(self, texts: lexical.Texts, known: np.ndarray):
        codes, bounds = lexical.code_points(texts)
        inside = ((codes >= 97) & (codes <= 122)) | ((codes >= 48) & (codes <= 57))
        starts, ends = lexical.runs(inside)
        line_ends = np.flatnonzero(codes == 10)
        self.line_starts = np.concatenate([[0], line_ends[:-1] + 1]) if len(line_ends) else np.zeros(0, np.int64)
        self.line_ends = line_ends
        self.line_doc = np.searchsorted(bounds, self.line_starts, "right") - 1
        #: The number of the line in its text.
        self.line_no = np.arange(len(line_ends)) - np.searchsorted(self.line_starts, bounds[:-1])[self.line_doc] if len(line_ends) else line_ends
        h = lexical.span_hashes(codes, starts, ends)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[at] == h
        line = np.searchsorted(line_ends, starts[hit])
        pairs = np.unique(line * len(known) + at[hit])
        #: Line and token of every distinct known token of a line.
        self.line, self.token = pairs // len(known), pairs % len(known)
        some = np.zeros(len(line_ends), bool)
        some[np.searchsorted(line_ends, starts)] = True
        begins = some.copy()
        begins[1:] &= ~some[:-1] | (self.line_doc[1:] != self.line_doc[:-1])
        ends_here = some.copy()
        ends_here[:-1] &= ~some[1:] | (self.line_doc[1:] != self.line_doc[:-1])
        #: First and last line of every paragraph.
        self.first_line, self.last_line = np.flatnonzero(begins), np.flatnonzero(ends_here)
        pairs = np.unique((np.cumsum(begins)[self.line] - 1) * len(known) + self.token)
        #: Paragraph and token of every distinct known token of a paragraph.
        self.paragraph, self.paragraph_token = pairs // len(known), pairs % len(known)
        self.codes = codes

    def text(self, line: int, last: int | None = None) -> str:
        return self.codes[self.line_starts[line] : self.line_ends[line if last is None else last]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def hashes_of(vocabulary: list[str]) -> np.ndarray:
    w = lexical.words(vocabulary)
    return w.hashes()


class Index:
    """The templates' tokens in global order, and what their filters need."""

    def __init__(self, templates: dict[str, str], frequency: dict[str, int], threshold: float):
        self.names = list(templates)
        sets = self.sets = [tokens(t) for t in templates.values()]
        #: The most words of a run of lines that is a match.
        self.most = [2 * len(TOKEN.findall(t.lower())) for t in templates.values()]
        vocabulary = sorted({t for s in sets for t in s}, key=lambda t: (frequency.get(t, 0), t))
        self.rank = {t: i for i, t in enumerate(vocabulary)}
        self.ordered = [sorted(self.rank[t] for t in s) for s in sets]
        self.need = [max(1, math.ceil(round(threshold * len(s), 9))) for s in sets]
        #: For each token's rank the templates that have it in their prefix, and where.
        self.prefixes: list[list[tuple[int, int]]] = [[] for _ in vocabulary]
        for k, own in enumerate(self.ordered):
            for i, r in enumerate(own[: len(own) - self.need[k] + 1]):
                self.prefixes[r].append((k, i))
        h = hashes_of(vocabulary)
        self.order = np.argsort(h)
        self.known = h[self.order]
        self.in_prefix = np.array([bool(p) for p in self.prefixes], bool)
        self.least = min(self.need, default=1)

    def matches(self, block: list[int]) -> list[tuple[int, int]]:
        """Templates and overlaps for a block given by the sorted ranks of its known tokens."""
        size, tried, found = len(block), set(), []
        for j, r in enumerate(block):
            for k, i in self.prefixes[r]:
                need = self.need[k]
                if k in tried or size < need or j > size - need:
                    continue
                if min(len(self.ordered[k]) - i, size - j) < need:
                    continue
                tried.add(k)
                overlap = len(set(block).intersection(self.ordered[k]))
                if overlap >= need:
                    found.append((k, overlap))
        return sorted(found)


def closest_run(lines: list[list[str]], want: set[str], most: int) -> tuple[int, int]:
    """Of the runs of lines (lists of words) of at most so many words, how many of want the best one holds, and its first line."""
    best = (0, 0, 0)
    for a in range(len(lines)):
        words, held = 0, set()
        for own in lines[a:]:
            words += len(own)
            if words > most:
                break
            held |= want.intersection(own)
            best = max(best, (len(held), -words, -a))
    return best[0], -best[2]


def block_frequencies(texts: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many blocks of the corpus each token occurs."""
    hashed = hashes_of(vocabulary)
    order = np.argsort(hashed)
    known, n = hashed[order], len(vocabulary)

    def make():
        def step(columns):
            rows = columns[0]
            for a, b in lexical.chunks(rows):
                step.total += np.bincount(Blocks(rows[a:b], known).token, minlength=n)

        step.total = np.zeros(n, np.int64)
        return step

    counts = summed_arrays(texts, make, n)
    return {vocabulary[order[i]]: int(c) for i, c in enumerate(counts)}


SCHEMA = "doc_id bigint, block int, template string, overlap int, containment double"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, paragraphs: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every block with every template it matches: doc_id, block (number of its first line from 0), template,
    overlap (shared tokens) and containment (their share of the template's, rounded to 6 places)."""
    templates = {k: v for k, v in (TEMPLATES if templates is None else templates).items() if tokens(v)}
    own = narrow(docs, id=id_col, text=text_col)
    if not templates:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    vocabulary = sorted({t for v in templates.values() for t in tokens(v)})
    index = Index(templates, block_frequencies(own.select("text"), vocabulary), threshold)

    def candidates(block: np.ndarray, token: np.ndarray, n: int) -> list[int]:
        """Blocks with enough known tokens and one that is in a prefix."""
        prefix = index.in_prefix[index.order[token]]
        return np.flatnonzero((np.bincount(block, minlength=n) >= index.least) & (np.bincount(block, prefix, minlength=n) > 0)).tolist()

    def make():
        def step(columns):
            ids, rows = columns[0].to_pylist(), columns[1]
            out = {"doc_id": [], "block": [], "template": [], "overlap": [], "containment": []}
            for a, b in lexical.chunks(rows):
                blocks = Blocks(rows[a:b], index.known)
                found = set()

                def add(line: int, last: int, a=a, blocks=blocks, found=found):
                    held = sorted(r for r in (index.rank.get(t) for t in tokens(blocks.text(line, last))) if r is not None)
                    for k, overlap in index.matches(held):
                        at = line
                        if last > line:
                            if any((x, k) in found for x in range(line, last + 1)):
                                continue
                            overlap, first = closest_run([TOKEN.findall(blocks.text(x).lower()) for x in range(line, last + 1)], set(index.sets[k]), index.most[k])
                            if overlap < index.need[k]:
                                continue
                            at += first
                        found.add((at, k))
                        for name, value in zip(out, (ids[a + blocks.line_doc[at]], int(blocks.line_no[at]), index.names[k], overlap, round(overlap / len(index.ordered[k]), 6)), strict=True):
                            out[name].append(value)

                for line in candidates(blocks.line, blocks.token, len(blocks.line_ends)):
                    add(line, line)
                for p in candidates(blocks.paragraph, blocks.paragraph_token, len(blocks.first_line)) if paragraphs else ():
                    if blocks.last_line[p] > blocks.first_line[p]:
                        add(int(blocks.first_line[p]), int(blocks.last_line[p]))
            yield out

        return step

    return per_batch(own, make, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def query_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and paragraphs; query has the lines of its SQL only."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), paragraphs=True)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SQL = f"""
WITH t(template, body) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES.items())}),
ts AS (SELECT template, list_distinct(regexp_extract_all(lower(body), '[a-z0-9]+')) AS tt FROM t),
l AS (SELECT doc_id, string_split(lower(text), chr(10)) AS ls FROM documents),
b AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls)))::INTEGER AS block FROM l),
s AS (SELECT doc_id, block, list_distinct(regexp_extract_all(line, '[a-z0-9]+')) AS bt FROM b),
o AS (SELECT doc_id, block, template, len(list_intersect(bt, tt))::INTEGER AS overlap, len(tt) AS size FROM s, ts)
SELECT doc_id, block, template, overlap, round(overlap::DOUBLE / size, 6) AS containment
FROM o WHERE overlap >= ceil(round({THRESHOLD} * size, 9))
"""
