"""Regular expressions in Java's dialect, and columns that find, count and classify their matches.

Word boundaries are written out for ASCII (START and END): Java's own are
aware of Unicode while its word class isn't.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

W = "[A-Za-z0-9_]"
START, END = f"(?<!{W})(?={W})", f"(?<={W})(?!{W})"
APOSTROPHES = "'`’"

POPULAR_TLDS = ["com", "org", "edu", "gov", "net", "mil", "uk", "ca", "de", "jp", "fr", "au", "us", "ru", "ch", "it", "nl", "se", "no", "es"]
#: More of the registered top-level domains; longer ones are tried first.
TLDS = sorted({*POPULAR_TLDS, *"aero asia biz cat coop info int jobs mobi museum name post pro tel travel xxx app blog cloud dev online shop site tech xyz ac ae af ag ai al am ao ar as at az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz cc cd cf cg ci ck cl cm cn co cr cu cv cw cx cy cz dj dk dm do dz ec ee eg er et eu fi fj fk fm fo ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is je jm jo ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs rw sa sb sc sd sg sh si sk sl sm sn so sr st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw".split()}, key=lambda x: (-len(x), x))
POPULAR_SCHEMES = sorted("http https ftp ssh git svn cvs smtp mailto telnet udp feed apt bitcoin gtalk content example chrome-extension".split(), key=lambda x: (-len(x), x))
SCHEMES = sorted({*POPULAR_SCHEMES, *"file data irc ldap news nfs rtsp sftp sip sips sms tel urn ws wss xmpp magnet gopher imap pop rsync".split()}, key=lambda x: (-len(x), x))


def bounded(pattern: str) -> str:
    """The pattern as whole words, in a group."""
    return f"{START}({pattern}){END}"


def one_of(words: list[str]) -> str:
    return "|".join(words)


HOST = "[a-zA-Z0-9.-]+"
FQDN = rf"{START}({HOST}[.](?:{one_of(TLDS)})){END}"
FQDN_POPULAR = rf"{START}({HOST}[.](?:{one_of(POPULAR_TLDS)})){END}"
USER = r"[a-zA-Z0-9.!#$%&*+,/=?^_`{|}~:;<>-]+"
_EMAIL_USER = r"[a-zA-Z0-9](?:[a-zA-Z0-9.!#$%&*+/=?^_`{|}~-]*[a-zA-Z0-9_])?"
EMAIL = rf"(?<!{W})({_EMAIL_USER}@[a-zA-Z0-9-]+(?:[.][a-zA-Z0-9-]+)*[.](?:{one_of(TLDS)})){END}"
EMAIL_POPULAR = rf"(?<!{W})({_EMAIL_USER}@[a-zA-Z0-9-]+(?:[.][a-zA-Z0-9-]+)*[.](?:{one_of(POPULAR_TLDS)})){END}"
AT = r"(?:[\s|\[({\"_=@-]+(?:AT|[Aa]t)[\s|\])}\"_=@-]+|@)"
DOT = r"(?:[\s|\[({\"_=.-]+(?:DOT|[Dd]ot|dt)[\s|\])}\"_=.-]+|[.])"
USER_OBFUSCATED = rf"(?:[a-zA-Z0-9!#$%&*+/?^`~]+{DOT}?){{1,7}}"
FQDN_OBFUSCATED = rf"(?:[a-zA-Z0-9-]+{DOT}){{1,7}}(?:{one_of(TLDS)})"
FQDN_POPULAR_OBFUSCATED = rf"(?:[a-zA-Z0-9-]+{DOT}){{1,7}}(?:{one_of(POPULAR_TLDS)})"
EMAIL_OBFUSCATED = rf"{START}({USER_OBFUSCATED}{AT}{FQDN_OBFUSCATED}){END}"
EMAIL_POPULAR_OBFUSCATED = rf"{START}({USER_OBFUSCATED}{AT}{FQDN_POPULAR_OBFUSCATED}){END}"
URL_PATH = rf"(?:{START}\S+|[/?#:]\S*)"
URL_SCHEME, URL_SCHEME_POPULAR = rf"(?:{one_of(SCHEMES)})://", rf"(?:{one_of(POPULAR_SCHEMES)})://"
URL = rf"{START}({URL_SCHEME}{HOST}[.](?:{one_of(TLDS)})(?!{W})(?:[/?#:]\S*(?<={W}))?)"
URL_POPULAR = rf"{START}({URL_SCHEME_POPULAR}{HOST}[.](?:{one_of(POPULAR_TLDS)})(?!{W})(?:[/?#:]\S*(?<={W}))?)"

LIST_BULLET = r"^\s*[\t !#%(*+.=-_]*[.0-9]*[#-_]*\s+"
NON_DIGIT, NON_PHRASE = r"[^0-9]+", r"[^A-Za-z0-9_\s/&'-]"
TIME_IN_PARENTHESES = r"(?i)([^(]*)[(]\s*([0-9]+)\s*(?:min\s*)?[)]([^(]*)"
NON_WORD_CHARACTER, WHITE_SPACE = f"[^{W[1:]}", r"\s"
NON_ASCII, NON_ASCII_RUN, ASCII = r"[^\x00-\x7F]", r"[^\x00-\x7F]+", r"[\x00-\x7F]"
EXPONENT = r"\s*(?:[xX]\s*10\s*[*^]{1,2}|[eE])\s*"
NOT_DIGITS_OR_COMMAS, NOT_DIGITS_OR_SIGNS = r"[^0-9,]+", r"[^0-9+-]+"
# The look-ahead only spares trying all four at the letters of words, where none can begin.
WORD_SEPARATOR = r"(?=\W)(?:\W*\s'{1,3}|'{1,3}\W+|[^A-Za-z0-9_.'-]+|\W+\s+)"
WORD_SEPARATOR_PERMISSIVE = r"[^A-Za-z0-9']\s[^A-Za-z0-9_]*|[^A-Za-z0-9_.'-]+"
SENTENCE_SEPARATOR = r"[.?!][^A-Za-z0-9_]+"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MONTH_NAME = f"(?i)({one_of(MONTHS)})[abcehilmorstuy]*"
JS_NAME = r"^[_$a-zA-Z -￿][_$a-zA-Z0-9 -￿]*$"
WIKIPEDIA_SPECIAL = "wikipedia[.]org/wiki/[^:]+:"
NO_VALUE = r"(?i)^(?:unkn?own|unkn?|none|null|nan|n/?a|[.]+|-+|=+|_+|[*]+|[?]+)$"
NOT_SYMBOL = "(?i:not)|[~!^-]"
NOT_OPERAND = rf"^({NOT_SYMBOL})?\s*(.*)\s*$"
SERIAL = "0{0,6}(?!0)[0-9]{4,10}"
NOT_SERIAL = rf"^\s*({NOT_SYMBOL})?\s*({SERIAL})\s*$"
VERSION = r"^\s*_{0,2}version_{0,2}\s*=\s*'(?:[0-9]*!)?([0-9]+)[.]([0-9]+)(?:[.]([0-9]+))?(?:(?:a|b|rc)[0-9]*)?'"

WORD = r"^([a-zA-Z][a-zA-Z_-]*[A-Za-z0-9_])[^A-Za-z0-9_]*$"
WORD_BASIC, WORD_LIBERAL = r"[.]?[a-zA-Z]+[0-9]*", r"[a-zA-Z0-9_.-]+"
WORD_CAPITALIZED, WORD_ACRONYM, WORD_LOWER = r"[A-Z][a-z]+[0-9]{0,3}", r"[A-Z0-9]{2,7}[0-9]{0,2}", r"[a-z]+[0-9]{0,3}"
CAMEL_BASIC, CAMEL_LONG = rf"(?:{WORD_CAPITALIZED}){{2,6}}", rf"(?:{WORD_CAPITALIZED}){{7,256}}"
CAMEL_NORMAL = rf"(?:{CAMEL_BASIC}|[a-z]+(?:{WORD_CAPITALIZED}){{1,5}})"
CAMEL = bounded(rf"{CAMEL_NORMAL}|{WORD_ACRONYM}(?:{WORD_CAPITALIZED}){{1,5}}|[a-z]{{0,24}}(?:{WORD_CAPITALIZED}){{1,5}}{WORD_ACRONYM}")
WORD_ALGEBRA = r"[+*/^!=().a-zA-Z0-9_'-]+"
QUOTES = ['"', *APOSTROPHES]


def quoted(pattern: str) -> str:
    return one_of([f"{q}{pattern}{q}" for q in QUOTES])


def joined_words(separator: str, least: int, most: int, word: str = WORD_BASIC) -> str:
    """least to most words with separators between them."""
    return f"(?:{word}{separator}){{{least - 1},{most - 1}}}{word}"


WORD_BASIC_QUOTED, WORD_LIBERAL_QUOTED, WORD_ALGEBRA_QUOTED = map(quoted, (WORD_BASIC, WORD_LIBERAL, WORD_ALGEBRA))
PHRASE_BASIC_QUOTED, PHRASE_LIBERAL_QUOTED, PHRASE_ALGEBRA_QUOTED = (quoted(f"(?:{w}|[^A-Za-z0-9_])+?") for w in (WORD_BASIC, WORD_LIBERAL, WORD_ALGEBRA))
WORD_UNDERSCORED, PHRASE_UNDERSCORED = joined_words("_+", 2, 3), joined_words("_+", 4, 64)
WORD_HYPHENATED, PHRASE_HYPHENATED = joined_words("-+", 2, 3), joined_words("-+", 4, 64)
HTML_TAG, DOUBLE_QUOTES = r"\s*<[^>]+>\s*", "\"+"
WORD_DELIMITER = rf"[^&a-zA-Z0-9_{APOSTROPHES}-]"
HYPHENATED_ALPHA, HYPHENATED_ALPHANUM = rf"{W}+-{W}+", rf"[a-zA-Z]{W}*-{W}*[a-zA-Z][0-9]*"
DOT_ALPHANUM, DOT_HYPHENATED = rf"[.]{WORD_BASIC}", rf"[.]{HYPHENATED_ALPHANUM}"
HYPHENATED_OR_DOTTED = rf"[a-zA-Z]{W}*[.-]{W}*[a-zA-Z][0-9]*"
POSSESSIVE = rf"{W}+'[sS]|{W}+-{W}+[sS]'|{W}+-{W}+"
HYPHENATED_POSSESSIVE = rf"{W}+-{W}+'[sS]|{W}+-{W}+[sS]'|{W}+-{W}+"
CONTRACTED = rf"[{APOSTROPHES}]tis|[{APOSTROPHES}]twas|{W}+[{APOSTROPHES}][a-zA-Z]{{1,2}}|{W}+"
USD_DECIMAL_SCALED, USD_SCALED, USD_CENTS, USD = r"\$[0-9]+[.][0-9]+[BMKk]", r"\$[0-9]+[BMKk]", r"\$[0-9]+[.][0-9][0-9]", r"\$[0-9]+"
FLOAT, FLOAT_E = r"[0-9]+[.]?[0-9]*", r"[0-9]+[.]?[0-9]* ?[eE] ?[0-9]+"
NON_SPACE, NON_WORD = r"\S+", r"[^\sA-Za-z0-9_]+"
YEAR = rf"{START}19[0-9][0-9]{END}|{START}20[0-9][0-9]{END}|(?<={W})'[0-9][0-9]{END}|{START}[0-9][0-9]{END}"
DECADE = rf"{START}(?:19|20)?[0-9]0'?s{END}"
ACRONYM = r"[A-Z0-9]{2,6}[0-9]{0,2}"
DOTTED_ACRONYM = rf"{START}(?:[A-Z][.]){{1,4}}(?={W})"
TOKEN = one_of([DOUBLE_QUOTES, DECADE, YEAR, bounded(ACRONYM), bounded(FLOAT_E), bounded(FLOAT), f"[.]{bounded(HYPHENATED_ALPHANUM)}", bounded(HYPHENATED_POSSESSIVE), bounded(HYPHENATED_OR_DOTTED), bounded(POSSESSIVE), bounded(HYPHENATED_ALPHA), bounded(HYPHENATED_ALPHANUM), bounded(CONTRACTED), NON_WORD])
#: Classes of tokens in the order in which they are tried.
TOKEN_CLASSES = {
    "usd_decimal_scaled": USD_DECIMAL_SCALED,
    "usd_scaled": USD_SCALED,
    "usd_cents": USD_CENTS,
    "usd": USD,
    "decade": DECADE,
    "year": YEAR,
    "acronym": ACRONYM,
    "float_e": FLOAT_E,
    "float": FLOAT,
    "hyphenated_alpha": HYPHENATED_ALPHA,
    "contracted_alpha": CONTRACTED,
    "nonword": NON_WORD,
}
#: All of a text's classed tokens, in one group each.
CLASSED_TOKEN = one_of([f"({p})" for p in TOKEN_CLASSES.values()])
BAD_FILENAME = r"[!\"#$%&'()*+,./:;<=>?@\[\\\]^`{|}~\x00-\x08\x0e-\x1f\x7f]"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PUNCTUATION_CLASS = r"[!-/:-@\[-`{-~]"
#: A constant that a source text sets at the beginning of two lines.
SET_TWICE = r"(?ms)^([A-Z][A-Z0-9_]*)\s*=.*^\1\s*="
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def has(text: Column, pattern: str) -> Column:
    """Whether the pattern is found anywhere."""
    return text.rlike(pattern)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def extract(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches, or a group of each."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def emails(text: Column, popular: bool = True, obfuscated: bool = False) -> Column:
    """E-mail addresses, with popular top-level domains or any; obfuscated: also such as 'a at b (dot) org'."""
    if obfuscated:
        return extract(text, EMAIL_POPULAR_OBFUSCATED if popular else EMAIL_OBFUSCATED)
    return extract(text, EMAIL_POPULAR if popular else EMAIL)


def urls(text: Column, popular: bool = False) -> Column:
    return extract(text, URL_POPULAR if popular else URL)


def token_class(token: Column) -> Column:
    """The first of TOKEN_CLASSES that matches the whole token, or null."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(TOKEN_CLASSES.items()):
        out = F.when(token.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def classed_tokens(text: Column) -> Column:
    """All tokens of the text with their classes: array of (token, class)."""
    return F.transform(extract(text, CLASSED_TOKEN), lambda t: F.struct(t.alias("token"), token_class(t).alias("class")))


def negation(text: Column) -> Column:
    """(operator, operand) of a text that may begin with not, ~, !, - or ^."""
    return F.struct(F.nullif(F.regexp_extract(text, NOT_OPERAND, 1), F.lit("")).alias("operator"), F.rtrim(F.regexp_extract(text, NOT_OPERAND, 2)).alias("operand"))


def version_parts(text: Column) -> Column:
    """(major, minor, patch) of a line that sets __version__; null where there is none."""
    part = lambda i: F.regexp_extract(text, VERSION, i).try_cast("int")
    return F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch"))


def minutes_in_parentheses(text: Column) -> Column:
    """(before, minutes, after) of the first number in parentheses."""
    g = lambda i: F.regexp_extract(text, TIME_IN_PARENTHESES, i)
    return F.struct(g(1).alias("before"), g(2).try_cast("int").alias("minutes"), g(3).alias("after"))
