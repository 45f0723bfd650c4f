"""Words, sentences, n-grams, k-mers and Treebank tokens as array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .strings import let, replace, strip_edge_punctuation, strip_html

#: Strings that aren't words.
NOT_WORDS = ("", "'", ".", "_", "-")


def words(
    text: Column,
    separator: str = P.WORD_SEPARATOR,
    preprocess: Callable[[Column], Column] = strip_html,
    postprocess: Callable[[Column], Column] = strip_edge_punctuation,
    min_length: int = 1,
    max_length: int = 256,
    blacklist: tuple[str, ...] = NOT_WORDS,
    whitelist: tuple[str, ...] | None = None,
    lower: bool = False,
) -> Column:
    """Words without tags and punctuation at their edges."""

    def good(w: Column) -> Column:
        ok = F.length(w).between(min_length, max_length)
        if blacklist:
            ok = ok & ~w.isin(*blacklist)
        return ok & w.isin(*whitelist) if whitelist else ok

    found = F.transform(F.split(preprocess(text), separator), lambda w: postprocess(w))
    if lower:
        found = F.transform(found, lambda w: F.lower(w))
    return F.filter(found, good)


def ascii_words(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def sentences(text: Column, separator: str = P.SENTENCE_SEPARATOR, keep: bool = False) -> Column:
    """Parts between sentence ends; empty ones are left out. keep: with the separators between them as parts of their own."""
    parts = F.split(replace(text, separator, "\u0000$0\u0000"), "\u0000") if keep else F.split(text, separator)
    return F.filter(parts, lambda s: s != "")


def _runs(items: Column, size: Callable[[Column], Column], n: int, part: Callable[[Column, Column], Column], kind: str) -> Column:
    """part(items, i) for all places i (from 1) that have n - 1 after them."""
    empty = F.expr(f"cast(array() as array<{kind}>)")
    return let(items, lambda v: F.when(size(v) >= n, F.transform(F.sequence(F.lit(1), size(v) - n + 1), lambda i: part(v, i))).otherwise(F.when(v.isNotNull(), empty)))


def slices(items: Column, n: int) -> Column:
    """All runs of n successive strings, as arrays; none where there are fewer."""
    return _runs(items, F.size, n, lambda v, i: F.slice(v, i, F.lit(n)), "array<string>")


def ngrams(items: Column, n: int = 2, separator: str | None = " ") -> Column:
    """Runs of n tokens, joined; as arrays if the separator is None."""
    if separator is None:
        return slices(items, n)
    if n == 1:
        return items
    return _runs(items, F.size, n, lambda v, i: F.concat_ws(separator, *[F.get(v, i + (k - 1)) for k in range(n)]) if n <= 4 else F.array_join(F.slice(v, i, F.lit(n)), separator), "string")


def ngram_structs(items: Column, n: int = 2) -> Column:
    """Runs of n tokens as structs w1 .. wn: cheaper to group and join than strings."""

    def zipped(v: Column) -> Column:
        size = F.greatest(F.size(v) - (n - 1), F.lit(0))
        return F.arrays_zip(*[F.slice(v, k, size).alias(f"w{k}") for k in range(1, n + 1)])

    kind = ", ".join(f"w{k}: string" for k in range(1, n + 1))
    return F.when(F.size(items) >= n, zipped(items)).otherwise(F.expr("array()")).cast(f"array<struct<{kind}>>")


def ngram_hashes(items: Column, n: int = 2) -> Column:
    """Two independent hashes (96 bits together) of each run of n tokens, as structs a, b: all that a join of runs needs."""

    def hashed(v: Column, i: Column) -> Column:
        words = [F.get(v, i + (k - 1)) for k in range(n)]
        return F.struct(F.xxhash64(*words).alias("a"), F.hash(*words).alias("b"))

    return _runs(items, F.size, n, hashed, "struct<a: bigint, b: int>")


def ngram_range(items: Column, most: int, least: int = 1, separator: str = " ") -> Column:
    """All n-grams of n from least to most, the shortest first."""
    return let(items, lambda v: F.flatten(F.array(*[ngrams(v, n, separator) for n in range(least, most + 1)])))


def kmers(text: Column, k: int = 4) -> Column:
    """All substrings of length k, in order."""
    return _runs(text, F.length, k, lambda v, i: F.substring(v, i, F.lit(k)), "string")


def sorted_kmers(text: Column, k: int = 4) -> Column:
    return F.sort_array(kmers(text, k))


def kmer_set(text: Column, k: int = 4) -> Column:
    return F.array_distinct(kmers(text, k))


def tokenize(text: Column, pattern: str = P.TOKEN, strip: str | None = "-_*`()\"", lower: bool = False, stop: tuple[str, ...] = (), stem: Callable[[Column], Column] | None = None, max_n: int = 1) -> Column:
    """Tokens that are words, without these characters and punctuation at the edges; then n-grams up to max_n."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def clean(t: Column) -> Column:
        if strip:
            t = F.btrim(t, F.lit(strip))
            t = F.btrim(t, F.lit(P.PUNCTUATION + " \t\n\r"))
        if stem:
            t = stem(t)
        return F.lower(t) if lower else t

    kept = F.filter(F.transform(found, clean), lambda t: (t != "") & ~t.rlike(r"^[^\sA-Za-z0-9_]") & (~t.isin(*stop) if stop else F.lit(True)))
    return kept if max_n <= 1 else ngram_range(kept, max_n)


def token_spans(text: Column, pattern: str = P.TOKEN) -> Column:
    """(token, start, end) of all tokens, by characters from 0."""
    empty = F.expr("cast(array() as array<struct<token: string, start: int, end: int>>)")

    def step(a: Column, t: Column) -> Column:
        at = F.position(t, text, a["at"])
        return F.struct((at + F.length(t)).alias("at"), F.concat(a["out"], F.array(F.struct(t.alias("token"), (at - 1).alias("start"), (at - 1 + F.length(t)).alias("end")))).alias("out"))

    return F.aggregate(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.struct(F.lit(1).alias("at"), empty.alias("out")), step, lambda a: a["out"])


def treebank(text: Column) -> Column:
    """Penn Treebank tokens: the public rules for quotes, punctuation, brackets and contractions, in their order."""
    s = text
    for pattern, by in (
        ('^"', "``"),
        ("``", " `` "),
        (r'([ (\[{<])"', "$1 `` "),
        ("([:,])([^0-9])", " $1 $2"),
        (r"[.]{3}", " ... "),
        ("[;@#$%&]", " $0 "),
        (r"([^.])([.])([\])}>\"']*)\s*\z", "$1 $2$3 "),
        ("[?!]", " $0 "),
        ("([^'])' ", "$1 ' "),
        (r"[\]\[(){}<>]", " $0 "),
        ("--", " -- "),
    ):
        s = replace(s, pattern, by)
    s = F.concat(F.lit(" "), s, F.lit(" "))
    s = replace(replace(s, '"', " '' "), r"(\S)('')", "$1 $2 ")
    s = replace(s, "(?i)([^' ])('[smd]|') ", "$1 $2 ")
    s = replace(s, "(?i)([^' ])('ll|'re|'ve|n't) ", "$1 $2 ")
    for first, second in (("can", "not"), ("d", "'ye"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("mor", "'n")):
        s = replace(s, f"(?i)(?<!{P.W})({first})({second})(?!{P.W})", "$1 $2 ")
    s = replace(s, f"(?i)(?<!{P.W})(wan)(na) ", "$1 $2 ")
    s = replace(s, f"(?i) ('t)(is|was)(?!{P.W})", " $1 $2 ")
    return F.filter(F.split(F.trim(s), r"\s+"), lambda t: t != "")


def filtered(tokens: Column, min_length: int = 1, max_length: int = 256, blacklist: tuple[str, ...] = (), whitelist: tuple[str, ...] | None = None) -> Column:
    """Tokens of a length, not in a black list, and in a white list if there is one."""

    def good(t: Column) -> Column:
        ok = F.length(t).between(min_length, max_length)
        ok = ok & ~t.isin(*blacklist) if blacklist else ok
        return ok & t.isin(*whitelist) if whitelist else ok

    return F.filter(tokens, good)
