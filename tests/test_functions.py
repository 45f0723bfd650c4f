from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from textloom.functions import coerce, dates, maths, strings, tokens
from textloom.functions import patterns as P


@pytest.fixture(scope="module")
def apply(spark):
    """Values of a column function over strings, all in one job."""

    def run(f, *values, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
        return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]

    return run


def test_words(apply):
    got = apply(tokens.words, "He said, \"don't\" and 'go'.", "<p>one</p> two", "", None)
    assert got[0] == ["He", "said", "don't", "and", "go"] and got[1] == ["one", "two"] and got[2] == [] and got[3] is None


def test_treebank(apply):
    got = apply(tokens.treebank, "Ripe apples cost $2.75\nin Old Rome.  Kindly get us\nfive of these.\nCheers.", "They'll save and invest more.", 'He said "cannot".')
    assert got[0] == "Ripe apples cost $ 2.75 in Old Rome. Kindly get us five of these. Cheers .".split()
    assert got[1] == "They 'll save and invest more .".split()
    assert got[2] == "He said `` can not '' .".split()


def test_ngrams_and_kmers(apply):
    split = lambda x: F.split(x, " ")
    assert apply(lambda x: tokens.ngrams(split(x), 2), "goodbye cruel world", "one") == [["goodbye cruel", "cruel world"], []]
    assert apply(lambda x: tokens.ngram_range(split(x), 3), "goodbye cruel world") == [["goodbye", "cruel", "world", "goodbye cruel", "cruel world", "goodbye cruel world"]]
    dna = "AGATAGATAGACACAGAAATGGGACCACAC"
    want = [dna[i : i + 4] for i in range(len(dna) - 3)]
    assert apply(tokens.kmers, dna, "ABC", None) == [want, [], None]
    assert apply(tokens.sorted_kmers, dna) == [sorted(want)]
    assert apply(tokens.kmer_set, dna) == [list(dict.fromkeys(want))]
    assert apply(lambda x: tokens.slices(split(x), 2), "a b c") == [[["a", "b"], ["b", "c"]]]


def test_sentences_and_spans(apply):
    assert apply(tokens.sentences, "One. Two! Three? four") == [["One", "Two", "Three", "four"]]
    spans = apply(lambda x: tokens.token_spans(x, "[a-z]+"), "ab cd ab")[0]
    assert [(s.token, s.start, s.end) for s in spans] == [("ab", 0, 2), ("cd", 3, 5), ("ab", 6, 8)]
    assert apply(lambda x: tokens.tokenize(x, lower=True, stop=("and",)), "Hello, world and all!") == [["hello", "world", "all"]]


def test_html_and_breaks(apply):
    assert apply(strings.strip_html, "a<b>c</b>d", "x > y", "a < b") == ["a c d", "x   y", "a "]
    assert apply(strings.strip_br, "date <BR />", "a<br>b", "x<br><br>") == ["date", "a<br>b", "x<br>"]


def test_identifiers(apply):
    assert apply(strings.identifier, "ID Number (9-digits)", "PD / SZ", "", None) == ["id_number_9_digits_", "pd_sz", None, None]
    assert apply(lambda x: strings.identifier(x, camel=True), "women in IT.csv") == ["WomenInItCsv"]
    assert apply(lambda x: strings.identifier(x, space="", unicode_letters=True), "pi (π)") == ["piπ"]
    assert apply(strings.slug, "Hello, Wörld!") == ["hello-world"]
    assert apply(lambda x: strings.with_extension(x, "csv"), "a/b.c/d.txt", "e") == ["a/b.c/d.csv", "e.csv"]
    assert apply(strings.filename, "a: b/c?.txt") == ["a-b-c-.txt"]


def test_shortening(apply):
    assert apply(lambda x: strings.truncate(x, 11), "Too verbose for its own good.", "short") == ["Too verbose...", "short"]
    assert apply(strings.shorten, "Hello World!", "customer number one of all") == ["Hello World", "cust num one of"]
    assert apply(lambda x: strings.shorten(x, 15), "Hello World! I'll talk your ear off!") == ["Hello World"]
    assert apply(strings.remove_internal_vowels, "hello beautiful") == ["hllobtfl"]


def test_slash_product(apply):
    got = apply(strings.slash_product, "I say goodbye/hello cruel/fun world.", "none")
    assert got == [["I say goodbye cruel world.", "I say goodbye fun world.", "I say hello cruel world.", "I say hello fun world."], ["none"]]


def test_serial_numbers(apply):
    assert apply(strings.serial_number, "1C 234567890             ", "Unknown", "12#345") == ["0234567890", "0000000000", "0000000345"]
    assert apply(lambda x: strings.serial_number(x, 20, fill=""), "1C 234567890   ") == ["1C 234567890"]
    assert apply(lambda x: P.has(x, f"^{P.SERIAL}"), "0000123744", "0", "0000", "0000001000", "000001", "000102952") == [True, False, False, True, False, True]


def test_postal_codes_and_digits(apply):
    assert apply(coerce.postal_code, "1234", "507.6009", "90210.0", "39567.7226", "x") == ["01234", "507", "90210", "39567-7226", ""]
    assert apply(coerce.first_digits, "+123.456", "abc") == [123, 0]
    assert [tuple(p) for p in apply(coerce.int_pair, "90210-007", "04321.0123", "x")] == [(90210, 7), (4321, 123), (0, None)]


def test_floats(apply):
    got = apply(coerce.to_float, "12,345", "12.345", "1+2", "+42.0", "\r\n-42?\r\n", "$42.42", "B-52", "1.2 x 10^34", "-INF", "", None, "none")
    assert got[:9] == [12345.0, 12.345, 3.0, 42.0, -42.0, 42.42, -52.0, 1.2e34, -math.inf] and got[9:] == [None, None, None]
    assert apply(coerce.scientific, " -123 x 10^-45 ", " -1+1,234 x 10^-5,678 ", "$42.42") == ["-123e-45", "1233e-5678", "42.42"]
    assert apply(coerce.to_int, "1,234", "-5.9", "x7") == [1234, -5, 7]
    assert apply(coerce.financial, "$1,200", "3.5k", "2M", "12 percent") == pytest.approx([1200.0, 3500.0, 2e6, 0.12])
    assert apply(coerce.year, "'27", "78", "1886", "x") == [2027, 1978, 1886, None]
    assert apply(coerce.to_bool, "Yes", "0", "maybe") == [True, False, None]
    assert apply(coerce.to_code, "7", "7.9", "Ab") == [7, 7, 97]


def test_column_dates(apply):
    assert apply(coerce.column_to_date, "10-Apr", "10_2011", "apr_10", "zz") == [dt.date(10, 4, 1), dt.date(2011, 10, 1), dt.date(10, 4, 1), None]
    assert coerce.count_label(["a", "Freq", "b"]) == "Freq" and coerce.count_label(["a"]) is None


def test_addresses(apply):
    assert apply(lambda x: P.emails(x, obfuscated=True), "Write jane.q (at) example.org, or else first@mail.example.com.", "Is it jim {dot} hill at example [dot] org?") == [["jane.q (at) example.org", "first@mail.example.com"], ["jim {dot} hill at example [dot] org"]]
    assert apply(P.urls, "See [this page](http://example.com/x/y?z=7), or svn://code.net.") == [["http://example.com/x/y?z=7", "svn://code.net"]]
    assert apply(P.emails, "a.b@c.org, x@y.zz") == [["a.b@c.org"]]


def test_pattern_library(apply):
    found = lambda p: lambda x: P.extract(x, p)
    assert apply(found(P.ACRONYM), "Hello ACRNYM cANDid ATe") == [["ACRNYM", "AND", "AT"]]
    assert apply(found(P.bounded(P.ACRONYM)), "Hello ACRNYM cANDid ATe") == [["ACRNYM"]]
    assert apply(found(P.CAMEL_NORMAL), "EPR: AlbertEinstein BorisPodolsky And NathanRosen") == [["AlbertEinstein", "BorisPodolsky", "NathanRosen"]]
    assert apply(found(P.CAMEL), "EinsteinPR: Einstein bPodolskyNRA NOTNRAPodolsky") == [["EinsteinPR", "bPodolskyNRA", "NOTNRAPodolsky"]]
    tough = "5by5 3_by_3\n7*8-6=50 Part3 .Org or a U"
    assert apply(found(P.WORD_BASIC), tough) == ["by5 by Part3 .Org or a U".split()]
    assert apply(found(P.WORD_ALGEBRA), tough) == ["5by5 3_by_3 7*8-6=50 Part3 .Org or a U".split()]
    assert apply(lambda x: F.split(x, P.EXPONENT), " 1E10 and 1 x 10 ^23 ") == [[" 1", "10 and 1", "23 "]]
    v = apply(P.version_parts, "__version__ = '0.0.18'")[0]
    assert (v.major, v.minor, v.patch) == (0, 0, 18)
    m = apply(P.minutes_in_parentheses, "boil ( 10 min) stir")[0]
    assert (m.before, m.minutes, m.after) == ("boil ", 10, " stir")
    n = apply(P.negation, "not red", "~x", "plain")
    assert [tuple(x) for x in n] == [("not", "red"), ("~", "x"), (None, "plain")]
    assert apply(P.token_class, "1970", "$1980", "people's", "not-so", "12.5", "3e4", "!!", "$3.50", "80s") == ["year", "usd", "contracted_alpha", "hyphenated_alpha", "float", "float_e", "nonword", "usd_cents", "decade"]


def test_maths(spark):
    pairs = [(1.0, 2.0), (1.0, 0.0), (-42.0, 0.0), (None, 3.0), (4.0, None)]
    got = [r.q for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a double, b double").select("i", maths.safe_div(F.col("a"), F.col("b")).alias("q")).orderBy("i").collect()]
    assert got == [0.5, math.inf, math.inf, 3.0, 4.0]
    row = spark.range(1).select(*[F.lit(v).cast("double").alias(f"v{i}") for i, v in enumerate((123456.0, 0.00123456, -9.876, 0.0))])
    got = row.select(*[maths.round_significant(F.col(c), 3).alias(c) for c in row.columns]).first()
    assert list(got) == pytest.approx([123000.0, 0.00123, -9.88, 0.0])
    assert [r.f for r in spark.range(0, 11).select(maths.fibonacci(F.col("id")).alias("f")).collect()] == [None, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55]
    counts = spark.createDataFrame([(11, 13, 1, 2)], "tp int, tn int, fp int, fn int")
    phi = counts.select(maths.mcc(*map(F.col, ("tp", "tn", "fp", "fn"))).alias("m")).first().m
    assert phi == pytest.approx(0.779017, abs=1e-5)
    assert [maths.opposite_label(x) for x in (None, True, 0, 1, -3, 7)] == [True, False, 1, 0, 3, 8]


def test_dates(spark):
    t = dt.datetime(1970, 1, 1, 12, 30, 45)
    df = spark.createDataFrame([(t, dt.datetime(2001, 2, 3, 4, 5, 6))], "a timestamp_ntz, b timestamp_ntz")
    r = df.select(
        dates.ordinal_float(F.lit("1970-01-01").cast("timestamp")).alias("o"), dates.ordinal(F.col("a")).alias("d"), dates.from_day_ordinal(F.lit(719163)).alias("back"),
        dates.from_ordinal(dates.ordinal_float(F.col("b"))).alias("again"), dates.time_tag(F.col("b")).alias("tag"), dates.time_tag(F.col("b"), "/", 3, filled=False).alias("short"),
        dates.quantize(F.col("b"), 3).alias("day"), dates.seconds(F.col("a")).alias("s"), dates.milliseconds(F.col("a")).alias("ms"), dates.days_since(F.col("b"), F.col("a")).alias("since"),
        dates.seconds_of_day(F.col("a")).alias("sod"), dates.epoch_seconds(F.lit(1970)).alias("e70"), dates.epoch_seconds(F.lit(2000)).alias("e00"), dates.epoch_datetime(F.lit(2000)).alias("y"),
        dates.century_shift(F.lit("2010-01-01").cast("date"), F.lit("1910-01-01").cast("date")).alias("c"), dates.market_close(F.lit("2020-01-01").cast("timestamp_ntz")).alias("close"),
    ).first()
    assert r.o == 719163.0 and r.d == 719163 and r.back == dt.date(1970, 1, 1) and r.again.replace(tzinfo=None) == dt.datetime(2001, 2, 3, 4, 5, 6)
    assert r.tag == "2001-02-03-04-05-06" and r.short == "2001/2/3" and r.day.day == 3 and r.day.hour == 0
    assert r.s == 45045 and r.ms == 45045000 and r.sod == 45045 and r.e70 == 0 and r.e00 == 946684800 and r.y.year == 2000 and r.c == 100 and r.close.hour == 16


def test_date_strings(apply):
    assert apply(dates.to_date, "2001-02-03", "2/3/2001", "3 Feb 2001", "rubbish", None) == [dt.date(2001, 2, 3)] * 3 + [dt.date(1970, 1, 1)] * 2
    assert apply(dates.time_of_day, "9:15", "09:15:30", "1:00 PM", "12:05 am", "25:00", "x") == [33300, 33330, 46800, 300, None, None]
    assert apply(dates.is_american_date, "12/31/99", "13/1/99", "1/2", "a/b/c") == [True, False, False, False]
    got = apply(dates.wiki_datetime, "at 12 30, 4 May 2010 (UTC)", "12:30, 4 May 2010")
    assert got[0] == got[1] and got[0].hour == 12


def test_text_cleaning(apply):
    assert apply(strings.to_ascii, "naïve", None) == ["na-ve", ""]
    assert apply(lambda x: strings.replace_nonascii(x, "?"), "aééb") == ["a?b"]
    assert apply(lambda x: strings.replace_nonascii(x, "?", True), "aééb") == ["a??b"]
    assert apply(strings.transcode_lookalikes, "“It’s” – ok é") == ['"It\'s" - ok ']
    assert apply(lambda x: strings.multisplit(x, ",; ", False), "a,b;; c") == [["a", "b", "c"]]
    assert apply(strings.clean_utf8, bytearray(b"ok \xc3\xa9"), bytearray(b"bad \xe9"), kind="binary") == ["ok é", "bad é"]
    assert apply(lambda x: strings.prefix_order(x, ["un", "ch"]), "Chad", "unit", "zoo") == [2, 1, 3]
    assert apply(lambda x: strings.is_ignorable(x, ["tmp"]), "/a/TMPfile", "/a/b") == [True, False]
    assert apply(lambda x: strings.similarity(x, F.lit("abcd")), "abcd", "abxd", "") == [1.0, 0.75, 0.0]


def test_sentences_with_separators(apply):
    assert apply(lambda x: tokens.sentences(x, keep=True), "One. Two? three")[0] == ["One", ". ", "Two", "? ", "three"]


def test_word_separator_skips_letters(spark):
    """It begins at no letter, and splits as its four parts alone do."""
    plain = r"[^A-Za-z0-9_]*\s'{1,3}|'{1,3}[^A-Za-z0-9_]+|[^A-Za-z0-9_.'-]+|[^A-Za-z0-9_]+\s+"
    odd = ["", " ", "a", "it's 'so' ''x''' y", "a.b. c... d -- e-f_g", "don't\t'quote'\n''", "Größe, naïve — 東京 \U0001f600x", "...'''...", "x  'y' \x0b'z", "end. ", "'''", None]
    table = spark.createDataFrame(list(enumerate(odd)), "i int, t string")
    assert all(r.a == r.b for r in table.select(F.split("t", P.WORD_SEPARATOR).alias("a"), F.split("t", plain).alias("b")).collect())
    assert P.WORD_SEPARATOR.startswith(r"(?=\W)")
