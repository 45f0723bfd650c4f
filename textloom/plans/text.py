"""Queries over texts: words, n-grams, k-mers, sentences, patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import strings, tokens
from ..operators import aggregates, boundaries
from ..operators.joins import top
from .registry import Tables, query

WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query(f"""
SELECT lang, word, n, rank FROM (
  SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word)::INTEGER AS rank
  FROM (SELECT lang, unnest({WORDS}) AS word FROM documents) GROUP BY lang, word) WHERE rank <= 20""")
def word_freq_by_lang(t: Tables):
    words = t.documents.select("lang", F.explode(tokens.ascii_words(F.col("text"))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    return top(counts, 20, ["lang"], [F.desc("n"), F.col("word")])


@query(f"""
SELECT bigram, count(*) AS n FROM (
  SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM (SELECT {WORDS} AS w FROM documents))
GROUP BY bigram ORDER BY n DESC, bigram LIMIT 50""")
def bigram_top(t: Tables):
    """Pairs are counted as pairs; only their counts' rows become strings."""
    pairs = t.documents.select(F.explode(tokens.ngram_structs(tokens.ascii_words(F.col("text")), 2)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return pairs.select(F.concat_ws(" ", "g.w1", "g.w2").alias("bigram"), "n").orderBy(F.desc("n"), "bigram").limit(50)


@query(f"""
SELECT doc_id, greatest(len(w), 0) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS n_grams FROM (SELECT doc_id, {WORDS} AS w FROM documents)""")
def ngram_range_size(t: Tables):
    return t.documents.select("doc_id", F.size(tokens.ngram_range(tokens.ascii_words(F.col("text")), 3)).cast("bigint").alias("n_grams"))


@query("""
SELECT kmer, count(*) AS n FROM (SELECT unnest(list_transform(range(1, length(p_name) - 2), lambda i: substring(p_name, i, 4))) AS kmer FROM part) GROUP BY kmer""")
def kmer_counts(t: Tables):
    return t.part.select(F.explode(tokens.kmers(F.col("p_name"), 4)).alias("kmer")).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_partkey, len(list_distinct(k)) AS n_distinct, list_min(k) AS first_kmer, len(k) AS n
FROM (SELECT p_partkey, list_transform(range(1, length(p_name) - 2), lambda i: substring(p_name, i, 4)) AS k FROM part)""")
def kmer_set_size(t: Tables):
    k = tokens.kmers(F.col("p_name"), 4)
    return t.part.select("p_partkey", F.size(tokens.kmer_set(F.col("p_name"), 4)).cast("bigint").alias("n_distinct"), F.try_element_at(tokens.sorted_kmers(F.col("p_name"), 4), F.lit(1)).alias("first_kmer"), F.size(k).cast("bigint").alias("n"))


@query(f"""
WITH d AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS g FROM (SELECT doc_id, {WORDS} AS w FROM documents)),
b AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) AS g FROM (SELECT item_id, {WORDS} AS w FROM benchmark))
SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (g) GROUP BY doc_id, item_id""")
def kmer_overlap_benchmark(t: Tables):
    """Runs of five words that documents share with benchmark items."""
    grams = lambda d, *k: d.select(*k, F.explode(tokens.ngram_hashes(tokens.ascii_words(F.col("text")), 5)).alias("g"))
    # Most runs of the documents have no partner, so they are made distinct after the join. Spark broadcasts the
    # benchmark's side if its size allows.
    found = grams(t.documents, "doc_id").join(grams(t.benchmark, "item_id").distinct(), "g")
    return found.distinct().groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))


@query("""
SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.?!][^A-Za-z0-9_]+'), lambda s: s <> '')) AS n_sentences FROM documents""")
def sentences_per_doc(t: Tables):
    return t.documents.select("doc_id", F.size(tokens.sentences(F.col("text"))).cast("bigint").alias("n_sentences"))


@query("""
SELECT page_id, length(s) AS n_chars, md5(s) AS digest FROM (
  SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*$', ''), '<[^>]*>|>', ' ', 'g') AS s FROM pages)""")
def html_stripped(t: Tables):
    s = strings.strip_html(F.col("html"))
    return t.pages.select("page_id", F.length(s).cast("bigint").alias("n_chars"), F.md5(s).alias("digest"))


@query("""
SELECT page_id, len(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(html, '<[^>]*$', ''), '<[^>]*>|>', ' ', 'g'), '[^-_.a-zA-Z0-9]+'), lambda w: trim(w, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~')), lambda w: length(w) BETWEEN 1 AND 256)) AS n_words FROM pages""")
def page_words(t: Tables):
    return t.pages.select("page_id", F.size(tokens.words(F.col("html"), separator="[^-_.a-zA-Z0-9]+")).cast("bigint").alias("n_words"))


@query("""
SELECT doc_id, len(e) AS n_emails, array_to_string(e, ' ') AS emails FROM (
  SELECT doc_id, regexp_extract_all(text, '[a-zA-Z0-9](?:[a-zA-Z0-9.!#$%&*+/=?^_`{|}~-]*[a-zA-Z0-9_])?@[a-zA-Z0-9-]+(?:[.][a-zA-Z0-9-]+)*[.](?:com|org|edu|gov|net|mil|uk|ca|de|jp|fr|au|us|ru|ch|it|nl|se|no|es)\\b') AS e FROM documents)
WHERE len(e) > 0""".replace("\\\\b", "\\b"))
def emails_found(t: Tables):
    e = P.emails(F.col("text"))
    return t.documents.select("doc_id", F.size(e).cast("bigint").alias("n_emails"), F.array_join(e, " ").alias("emails")).where("n_emails > 0")


@query(r"""
SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS params FROM pages""")
def url_parts(t: Tables):
    u = F.col("url")
    part = lambda p: F.coalesce(F.try_parse_url(u, F.lit(p)), F.lit(""))
    return t.pages.select("page_id", F.lower(part("PROTOCOL")).alias("scheme"), part("HOST").alias("host"), part("PATH").alias("path"), part("QUERY").alias("params"))


@query(r"""
SELECT doc_id, len(regexp_extract_all(text, '\$[0-9]+')) AS n_usd, len(regexp_extract_all(text, '[0-9]+[.]?[0-9]*')) AS n_floats, len(regexp_extract_all(text, '[^\sA-Za-z0-9_]+')) AS n_nonwords FROM documents""")
def pattern_counts(t: Tables):
    c = lambda p: P.count(F.col("text"), p).cast("bigint")
    return t.documents.select("doc_id", c(P.USD).alias("n_usd"), c(P.FLOAT).alias("n_floats"), c(P.NON_WORD).alias("n_nonwords"))


@query(r"""
SELECT class, sum(n)::BIGINT AS n FROM (
  SELECT n, CASE WHEN regexp_full_match(w, '\$[0-9]+[.][0-9]+[BMKk]') THEN 'usd_decimal_scaled' WHEN regexp_full_match(w, '\$[0-9]+[BMKk]') THEN 'usd_scaled'
    WHEN regexp_full_match(w, '\$[0-9]+[.][0-9][0-9]') THEN 'usd_cents' WHEN regexp_full_match(w, '\$[0-9]+') THEN 'usd'
    WHEN regexp_full_match(w, '((19|20)?[0-9]0''?s)') THEN 'decade' WHEN regexp_full_match(w, '(19|20)?[0-9][0-9]') THEN 'year'
    WHEN regexp_full_match(w, '[A-Z0-9]{2,6}[0-9]{0,2}') THEN 'acronym' WHEN regexp_full_match(w, '[0-9]+[.]?[0-9]* ?[eE] ?[0-9]+') THEN 'float_e'
    WHEN regexp_full_match(w, '[0-9]+[.]?[0-9]*') THEN 'float' WHEN regexp_full_match(w, '[A-Za-z0-9_]+-[A-Za-z0-9_]+') THEN 'hyphenated_alpha'
    WHEN regexp_full_match(w, '[''`’](tis|twas)|[A-Za-z0-9_]+[''`’][a-zA-Z]{1,2}|[A-Za-z0-9_]+') THEN 'contracted_alpha' WHEN regexp_full_match(w, '[^ \t\n\r\f\vA-Za-z0-9_]+') THEN 'nonword' ELSE 'none' END AS class
  FROM (SELECT w, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\r\f\v]+')) AS w FROM documents) WHERE w <> '' GROUP BY w)) GROUP BY class""")
def token_class_counts(t: Tables):
    """What stands between white space, classified once for each distinct token."""
    words = t.documents.select(F.explode(F.split("text", r"[ \t\n\r\f\x0B]+")).alias("w")).where("w <> ''")
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(F.coalesce(P.token_class(F.col("w")), F.lit("none")).alias("class")).agg(F.sum("n").alias("n"))


def _treebank_sql(text: str) -> str:
    rules = [
        ('^"', "``"), ("``", " `` "), (r'([ (\[{<])"', r"\1 `` "), ("([:,])([^0-9])", r" \1 \2"), ("[.]{3}", " ... "), ("[;@#$%&]", r" \0 "),
        (r"([^.])([.])([\])}>\"']*)\s*$", r"\1 \2\3 "), ("[?!]", r" \0 "), ("([^'])' ", r"\1 ' "), (r"[\]\[(){}<>]", r" \0 "), ("--", " -- "),
    ]
    rest = [('"', " '' "), (r"(\S)('')", r"\1 \2 "), ("(?i)([^' ])('[smd]|') ", r"\1 \2 "), ("(?i)([^' ])('ll|'re|'ve|n't) ", r"\1 \2 ")]
    rest += [(rf"(?i)\b({a})({b})\b", r"\1 \2 ") for a, b in (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("mor", "'n"))] + [(r"(?i)\b(wan)(na) ", r"\1 \2 "), (r"(?i) ('t)(is|was)\b", r" \1 \2 ")]
    q = lambda x: "'" + x.replace("'", "''") + "'"
    for p, by in rules:
        text = f"regexp_replace({text}, {q(p)}, {q(by)}, 'g')"
    text = f"(' ' || {text} || ' ')"
    for p, by in rest:
        text = f"regexp_replace({text}, {q(p)}, {q(by)}, 'g')"
    return text


@query(rf"""
SELECT conv_id, turn, len(list_filter(regexp_split_to_array(trim(s), '\s+'), lambda x: x <> '')) AS n_tokens, md5(array_to_string(list_filter(regexp_split_to_array(trim(s), '\s+'), lambda x: x <> ''), ' ')) AS digest FROM (SELECT conv_id, turn, {_treebank_sql("text")} AS s FROM conversations)""")
def treebank_token_count(t: Tables):
    found = tokens.treebank(F.col("text"))
    return t.conversations.select("conv_id", "turn", F.size(found).cast("bigint").alias("n_tokens"), F.md5(F.array_join(found, " ")).alias("digest"))


@query("""
SELECT doc_id, length(regexp_replace(text, '[^\\x00-\\x7F]+', '?', 'g')) AS n_runs, length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) AS n_ascii, md5(regexp_replace(text, '[^\\x00-\\x7F]', '-', 'g')) AS digest FROM documents""")
def nonascii_clean(t: Tables):
    x = F.col("text")
    return t.documents.select("doc_id", F.length(strings.replace_nonascii(x, "?")).cast("bigint").alias("n_runs"), F.length(strings.strip_nonascii(x)).cast("bigint").alias("n_ascii"), F.md5(strings.to_ascii(x)).alias("digest"))


@query(f"""
WITH w AS (SELECT doc_id, unnest({WORDS}) AS token FROM documents),
tf AS (SELECT doc_id AS doc, token, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token), n AS (SELECT count(DISTINCT doc) AS n FROM tf)
SELECT doc, token, tf, round(tf * ln(n / df), 6) AS tfidf, rank FROM (
  SELECT doc, token, tf, n, df, row_number() OVER (PARTITION BY doc ORDER BY round(tf * ln(n / df), 6) DESC, token)::INTEGER AS rank FROM tf JOIN df USING (token), n) WHERE rank <= 3""")
def tfidf_top(t: Tables):
    """Texts are brought together by document, as they are smaller than their words with the document's id. A number of partitions keeps adaptive execution from merging them, whose words are far larger."""
    parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    words = t.documents.select("doc_id", "text").repartition(parts, "doc_id").select("doc_id", F.explode(tokens.ascii_words(F.col("text"))).alias("token"))
    some = t.documents.where(F.lower("text").rlike("[a-z0-9]"))
    scores = aggregates.term_scores(words, "doc_id", "token", some).withColumn("tfidf", F.round("tfidf", 6))
    return top(scores, 3, ["doc"], [F.desc("tfidf"), F.col("token")]).drop("df")


@query(f"""
SELECT doc_id, array_to_string(w[1:3], ' ') AS start, len(w) AS n, len(list_filter(w, lambda x: length(x) BETWEEN 4 AND 8 AND x NOT IN ('this', 'that'))) AS n_kept FROM (SELECT doc_id, {WORDS} AS w FROM documents)""")
def filtered_words(t: Tables):
    w = tokens.ascii_words(F.col("text"))
    return t.documents.select("doc_id", F.array_join(F.slice(w, 1, 3), " ").alias("start"), F.size(w).cast("bigint").alias("n"), F.size(tokens.filtered(w, 4, 8, blacklist=("this", "that"))).cast("bigint").alias("n_kept"))


@query(f"""
WITH a AS (SELECT DISTINCT doc_id AS doc, unnest({WORDS}) AS token FROM documents), b AS (SELECT DISTINCT unnest({WORDS}) AS token FROM benchmark)
SELECT doc, count(*) AS n_tokens, count(b.token) AS n_shared, round(count(b.token) / count(*), 6) AS share FROM a LEFT JOIN b USING (token) GROUP BY doc""")
def vocabulary_shared(t: Tables):
    words = lambda d, *k: d.select(*k, F.explode(tokens.ascii_words(F.col("text"))).alias("token"))
    return aggregates.vocabulary_similarity(words(t.documents, "doc_id"), words(t.benchmark), "doc_id", "token").withColumn("share", F.round("share", 6))


@query("""
WITH k AS (SELECT DISTINCT p_partkey AS doc, unnest(list_transform(range(1, length(p_name) - 2), lambda i: substring(p_name, i, 4))) AS kmer FROM part),
d AS (SELECT kmer, count(*) AS df FROM k GROUP BY kmer)
SELECT doc, kmer AS tag, df FROM (SELECT doc, kmer, df, row_number() OVER (PARTITION BY doc ORDER BY df, kmer) AS r FROM k JOIN d USING (kmer)) WHERE r = 1""")
def unique_tags(t: Tables):
    return aggregates.unique_tags(t.part, "p_partkey", "p_name")


@query("""
SELECT doc_id, length(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS n_slug FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS text FROM documents)""")
def slug_lengths(t: Tables):
    return t.documents.select("doc_id", F.length(strings.slug(strings.strip_nonascii(F.col("text")))).cast("bigint").alias("n_slug"))


@query()
def learned_sentences(t: Tables):
    """Sentences by the boundary detector's rule."""
    return t.conversations.select("conv_id", "turn", F.posexplode(boundaries.segmented(F.col("text"))).alias("place", "sentence"))


@query()
def classic_tokens(t: Tables):
    """Token counts of the pattern tokenizer with bigrams."""
    return t.conversations.select("conv_id", "turn", F.size(tokens.tokenize(F.col("text"), lower=True, max_n=2)).alias("n_tokens"))
