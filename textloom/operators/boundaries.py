"""Sentence boundaries by a trained classifier: candidates, features, an averaged perceptron and segmentation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT = 32
CANDIDATE = re.compile(r"""(.*?)([.?!]+)(["'”’)\]}]*)(\s+)""", re.S)
LEFT, RIGHT = re.compile(r"(\S+)\s*$"), re.compile(r"\s*(\S+)")
NUMBER, QUOTE = re.compile(r"^[$€£]?\d[\d,.]*%?$"), re.compile("^[\"'`“”‘’]+$")
VOWELS = frozenset("aeiouyAEIOUY")


@dataclass(frozen=True)
class Candidate:
    left: str
    mark: str
    right: str
    newline: bool
    end: int


def candidates(text: str | None) -> Iterator[Candidate]:
    """Marks that may end a sentence, with the words beside them. end: where the mark and its closing quotes end."""
    for m in re.finditer(r"""([.?!]+)(["'”’)\]}]*)(\s+)""", text or ""):
        before, after = text[max(0, m.start() - CONTEXT) : m.start()], text[m.end() : m.end() + CONTEXT]
        left, right = LEFT.search(before), RIGHT.match(after)
        if right:
            yield Candidate(left[1] if left else "", m[1], right[1], "\n" in m[3], m.end(2))


def _word(w: str) -> str:
    return "*NUMBER*" if NUMBER.match(w) else "*QUOTE*" if QUOTE.match(w) else w


def features(c: Candidate, fold_case: bool = False) -> list[str]:
    left, right = _word(c.left.lower() if fold_case else c.left), _word(c.right.lower() if fold_case else c.right)
    out = ["bias", f"mark:{c.mark}", f"left:{left}", f"right:{right}", f"both:{left}|{right}"]
    if c.newline:
        out.append("newline")
    if c.mark == ".":
        out += [f"left length:{min(len(c.left), 8)}", f"left dots:{'.' in c.left}", f"left vowels:{bool(VOWELS & set(c.left))}"]
        if not fold_case:
            out += [f"left case:{_case(c.left)}", f"right case:{_case(c.right)}"]
    return out


def _case(w: str) -> str:
    return "digit" if w[:1].isdigit() else "upper" if w.isupper() else "title" if w[:1].isupper() else "lower" if w.islower() else "other"


@dataclass
class Detector:
    """weights None: a rule (a mark other than a period, a newline, or a following capital after a word of over two letters)."""

    weights: dict[str, float] | None = None
    fold_case: bool = False
    known: frozenset = field(default_factory=frozenset)

    def is_end(self, c: Candidate) -> bool:
        if self.weights is None:
            return c.mark != "." or c.newline or (not c.right[:1].islower() and len(c.left.rstrip(".")) > 2)
        return sum(self.weights.get(f, 0.0) for f in features(c, self.fold_case)) > 0

    def segments(self, text: str | None) -> list[str]:
        out, at = [], 0
        for c in candidates(text):
            if self.is_end(c):
                out.append(text[at : c.end].strip())
                at = c.end
        last = (text or "")[at:].strip()
        return [s for s in [*out, last] if s]


def train(sentences: list[list[str]] | list[str], epochs: int = 20, fold_case: bool = False) -> Detector:
    """An averaged perceptron over texts given as lists of sentences. The training set is in the program."""
    data = []
    for doc in ([sentences] if sentences and isinstance(sentences[0], str) else sentences):
        text, ends = "", set()
        for s in doc:
            text += s
            ends.add(len(text))
            text += " "
        data += [(features(c, fold_case), c.end in ends) for c in candidates(text)]
    weights: dict[str, float] = {}
    totals: dict[str, float] = {}
    step = 1
    for _ in range(epochs):
        for fs, gold in data:
            if (sum(weights.get(f, 0.0) for f in fs) > 0) != gold:
                for f in fs:
                    d = 1.0 if gold else -1.0
                    weights[f] = weights.get(f, 0.0) + d
                    totals[f] = totals.get(f, 0.0) + step * d
            step += 1
    return Detector({f: w - totals[f] / step for f, w in weights.items()}, fold_case)


def segmented(text: Column, detector: Detector | None = None) -> Column:
    """The sentences of a text."""
    own = detector or Detector()

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(own.segments)

    return run(text)


def evaluated(table: DataFrame, sentences: str, detector: Detector | None = None) -> DataFrame:
    """gold, predicted and n over all candidates of arrays of sentences."""
    own = detector or Detector()

    @F.pandas_udf("array<struct<gold: boolean, predicted: boolean>>")
    def run(docs: pd.Series) -> pd.Series:
        def one(doc):
            text, ends = "", set()
            for s in [] if doc is None else doc:
                text += s
                ends.add(len(text))
                text += " "
            return [{"gold": c.end in ends, "predicted": own.is_end(c)} for c in candidates(text)]

        return docs.map(one)

    return table.select(F.explode(run(F.col(sentences))).alias("c")).groupBy("c.gold", "c.predicted").agg(F.count(F.lit(1)).alias("n"))
