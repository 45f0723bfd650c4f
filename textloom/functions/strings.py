"""Scalar string functions: Column to Column, without Python at run time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

ABBREVIATIONS = {
    "account": "acct",
    "building": "bldg",
    "customer": "cust",
    "member": "membr",
    "number": "num",
    "serial number": "SN",
    "social security number": "SSN",
}
#: Look-alikes beyond ASCII.
LOOKALIKES = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "×": "x", "´": "'", "…": ".", " ": " "}
ACCENTED = "àáâãäåèéêëìíîïòóôõöùúûüýÿñçÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝÑÇ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuyyncAAAAAAEEEEIIIIOOOOOUUUUYNC"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once a row, however often use refers to it."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def replace(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def strip_br(text: Column) -> Column:
    """Without one line-break tag at the end."""
    return replace(text, r"\s*<\s*[Bb][Rr]\s*/?\s*>\s*\z", "")


def strip_html(text: Column) -> Column:
    """Tags become spaces; what follows an unclosed < goes."""
    return replace(replace(text, r"<[^>]*\z", ""), "<[^>]*>|>", " ")


def strip_edge_punctuation(text: Column, characters: str = P.PUNCTUATION, lower: bool = False) -> Column:
    out = F.btrim(text, F.lit(characters))
    return F.lower(out) if lower else out


def strip_punctuation_and_space(text: Column) -> Column:
    return F.btrim(text, F.lit(P.PUNCTUATION + " \t\n\r\x0b\x0c"))


def to_ascii(value: Column, filler: str = "-") -> Column:
    """As a string ('' for null) with each character beyond ASCII replaced."""
    return replace(F.coalesce(value.cast("string"), F.lit("")), P.NON_ASCII, filler)


def replace_nonascii(text: Column, filler: str = " ", one_for_one: bool = False) -> Column:
    """With each run of characters beyond ASCII, or each of them, replaced."""
    return replace(text, P.NON_ASCII if one_for_one else P.NON_ASCII_RUN, filler)


def strip_nonascii(text: Column) -> Column:
    return replace_nonascii(text, "")


def encode_utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def clean_utf8(data: Column) -> Column:
    """Bytes as text: UTF-8 if valid, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(data.cast("string")), F.decode(data, "ISO-8859-1"))


def transcode_lookalikes(text: Column) -> Column:
    """Typographic look-alikes as ASCII; the rest beyond ASCII goes."""
    return strip_nonascii(F.translate(text, "".join(LOOKALIKES), "".join(LOOKALIKES.values())))


def multisplit(text: Column, separators: str, keep_blank: bool = True) -> Column:
    """Split at any of the separators."""
    parts = F.split(text, "[" + "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in separators) + "]")
    return parts if keep_blank else F.filter(parts, lambda x: x != "")


def remove_internal_vowels(text: Column, space: str = "") -> Column:
    """Lower-case vowels between two letters go; white space becomes space.

    A run of vowels goes but for none; repeated three times, which settles every run, as a match takes all vowels that have a letter before and after."""
    out = text
    for _ in range(3):
        out = replace(out, "(?<=[A-Za-z])[aeiou]+(?=[A-Za-z])", "")
    return replace(out, r"\s", space)


def truncate(text: Column, length: int = 20, ellipsis: str = "...") -> Column:
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit(ellipsis))).otherwise(text)


def abbreviate(text: Column, words: dict[str, str] | None = None) -> Column:
    table = ABBREVIATIONS if words is None else words
    out = text
    for long, short in table.items():
        out = F.when(text == long, F.lit(short)).otherwise(out)
    return out


def shorten(text: Column, length: int = 16) -> Column:
    """As many of the first words, abbreviated, as fit into the length; the first is cut if it doesn't."""
    from .tokens import words

    short = F.transform(words(text), lambda w: abbreviate(w))
    longest = F.aggregate(
        short,
        F.struct(F.lit("").alias("s"), F.lit(False).alias("done")),
        lambda a, w: F.when(a["done"], a).otherwise(
            F.when(a["s"] == "", F.struct(w.alias("s"), (F.length(w) > length).alias("done"))).otherwise(
                F.when(F.length(a["s"]) + 1 + F.length(w) <= length, F.struct(F.concat(a["s"], F.lit(" "), w).alias("s"), F.lit(False).alias("done"))).otherwise(F.struct(a["s"].alias("s"), F.lit(True).alias("done")))
            )
        ),
        lambda a: a["s"],
    )
    return F.left(longest, F.lit(length))


def slug(*values: Column, length: int | None = None, delimiter: str = "-") -> Column:
    """Values joined, in lower-case ASCII, with other characters as delimiters."""
    joined = F.translate(F.concat_ws(delimiter, *values), ACCENTED, PLAIN)
    out = F.trim(replace(F.lower(joined), "[^a-z0-9]+", "-"))
    out = F.btrim(out, F.lit("-"))
    if delimiter != "-":
        out = F.replace(out, F.lit("-"), F.lit(delimiter))
    return out if length is None else F.btrim(F.left(out, F.lit(length)), F.lit(delimiter))


def identifier(text: Column, camel: bool = False, lower: bool = True, space: str = "_", remove_prefix: str | None = None, unicode_letters: bool = False) -> Column:
    """A name for a variable, or camel-cased for a class. '' and null give null."""
    out = text
    if remove_prefix:
        out = F.when(F.startswith(out, F.lit(remove_prefix)), F.substring(out, len(remove_prefix) + 1, 1 << 30)).otherwise(out)
    if camel:
        spaced = replace(replace(F.lower(out), "[^a-z0-9]+", " "), "([0-9])([a-z])", "$1 $2")
        needs = out.rlike(P.PUNCTUATION_CLASS + r"|\s") | (F.lower(out) == out)
        out = F.when(needs, F.replace(F.initcap(spaced), F.lit(" "), F.lit(""))).otherwise(replace(out, "[^a-zA-Z0-9]+", ""))
    else:
        out = F.lower(out) if lower else out
        out = replace(out, r"(?U)[^\w]+" if unicode_letters else "[^a-zA-Z0-9]+", space)
    return F.nullif(out, F.lit("")) if camel else F.when(text == "", None).otherwise(out)


def filename(text: Column, space: str = "-", strict: bool = False, length: int = 60) -> Column:
    """A portable file name."""
    out = identifier(text, lower=False) if strict else replace(text, r"[ :\\/?*&\"<>|~`!]+", space)
    return F.left(out, F.lit(length))


def with_extension(name: Column, extension: str, separator: str = ".") -> Column:
    """A file name whose extension (after the last separator) is this one."""
    e = extension.lstrip(separator)
    stem = replace(name, rf"(?<=[^/])[{separator}][^{separator}/]*\z", "")
    return F.concat(stem, F.lit(separator + e))


def last_field(name: Column, separator: str = "__") -> Column:
    """The part after the last separator."""
    return F.element_at(F.split(name, separator), -1)


def plural_field(name: Column, separator: str = "__") -> Column:
    """The last field's name with an s, unless it has one."""
    last = last_field(name, separator)
    return F.when(last.endswith("s"), last).otherwise(F.concat(last, F.lit("s")))


def names(text: Column) -> Column:
    """Names from a text with commas between them."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x))


def serial_number(text: Column, length: int = 10, fill: str = "0", blank: str = "", invalid: str = "[^0-9a-zA-Z -]", join: bool = False, strip: bool = True) -> Column:
    """What follows the last invalid character, without white space, its last characters, filled at the left.

    join: invalid characters are deleted instead. Words for no value become blank (then filled)."""
    out = F.trim(text) if strip else text
    out = replace(out, f"^(?:{invalid})+|(?:{invalid})+\\z", "")
    out = replace(out, invalid, "") if join else F.element_at(F.split(out, invalid), -1)
    out = F.when(out.rlike(P.NO_VALUE), F.lit(blank)).otherwise(F.trim(out) if strip else out)
    out = F.right(out, F.lit(length))
    out = F.trim(out) if strip else out
    return F.when(F.length(out) < length, F.lpad(out, length, fill)).otherwise(out) if fill else out


def slash_product(text: Column) -> Column:
    """All readings of a phrase with alternatives between slashes, the first alternatives first."""
    return F.transform(
        F.aggregate(
            F.split(text, " "),
            F.array(F.lit("")),
            lambda done, word: F.flatten(F.transform(done, lambda p: F.transform(F.split(word, "/"), lambda x: F.concat(p, F.lit(" "), x)))),
        ),
        lambda s: F.substring(s, 2, 1 << 30),
    )


def is_ignorable(text: Column, ignorable: list[str], lower: bool = True, basename: bool = True, prefix: bool = True) -> Column:
    """Whether a string (or a path's last part) is one of these, or begins with one."""
    s = F.element_at(F.split(text, "/"), -1) if basename else text
    s = F.lower(s) if lower else s
    out = F.lit(False)
    for i in ignorable:
        i = i.lower() if lower else i
        out = out | (s.startswith(i) if prefix else s == i)
    return F.coalesce(out, F.lit(False))


def similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance's share of the longer length; 1.0 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def prefix_order(text: Column, order: list[str], case_sensitive: bool = False) -> Column:
    """The place of the string's prefix in a list (from 1), after all others if it isn't there."""
    n = max(map(len, order))
    s, wanted = (text, order) if case_sensitive else (F.lower(text), [o.lower() for o in order])
    at = F.array_position(F.array(*[F.lit(o) for o in wanted]), F.left(s, F.lit(n)))
    return F.when(at > 0, at).otherwise(F.lit(len(order) + 1))
