"""Quality rules: a hashed n-gram log-likelihood ratio.

Tokens (words with their case kept, and runs of punctuation) and pairs of
adjacent tokens are hashed into a fixed number of buckets.
Two multinomials are counted over the buckets: the target's over all trusted
documents, the raw one over all documents. The target's counts are brought to
the raw total, and both get PSEUDO counts a bucket, so that a bucket tells
something once it is seen often enough, whatever the share of trusted
documents and the size of the corpus. A document's score is the mean over its n-grams of
log p_target(bucket) - log p_raw(bucket); it is kept if that is at least the
threshold.

The hash is a polynomial in the code points modulo 2**31 - 1, so that SQL can
compute it as well.

Cases: a null or blank text has no n-grams, scores 0.0 and is
rejected as it has nothing to keep. Repeated rows count and score as often as
they occur; a doc_id in more than one row makes all its rows trusted if it is
trusted. A null doc_id is never trusted. Without trusted documents there is nothing to
tell the two models apart: every n-gram has 0.0, and all texts that have any
are kept. A score equal to the threshold is kept. Very long texts count whole. An
empty table gives no rows. Extra columns, whatever their names, play no part;
keep_documents returns them as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lexical
from .frames import broadcast_checked, keep_where, narrow, positional, settled, summed_arrays, trim

BUCKETS = 1 << 16
#: Documents score about 0 if their n-grams are those of trusted text; foreign n-grams pull the mean down.
THRESHOLD = -0.2
#: Added to each bucket of both models.
PSEUDO = 20
PRIME = (1 << 31) - 1
BASE, PAIR = 257, 1_000_003

_TABLES: dict[int, np.ndarray] = {}


def _modular_powers(base: int, n: int) -> np.ndarray:
    have = _TABLES.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.ones(1, np.int64)
        while len(have) < size:
            have = np.concatenate([have, have * pow(base, len(have), PRIME) % PRIME])
        _TABLES[base] = have
    return have[:n]


def word_codes(w: lexical.Words) -> np.ndarray:
    """Horner's value of each word's code points in base 257, modulo the prime."""
    n = len(w.codes)
    total = np.zeros(n + 1, np.int64)
    np.cumsum(w.codes.astype(np.int64) * _modular_powers(pow(BASE, -1, PRIME), n) % PRIME, out=total[1:])
    return (total[w.ends] - total[w.starts]) % PRIME * _modular_powers(BASE, n + 1)[w.ends - 1] % PRIME


def features(texts: lexical.Texts, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all tokens and token pairs, and the index of the text of each."""
    w = lexical.tokens(texts)
    h = word_codes(w)
    pair = (h[:-1] * PAIR + h[1:]) % PRIME
    same = w.doc[:-1] == w.doc[1:]
    return np.concatenate([h, pair[same]]) % buckets, np.concatenate([w.doc, w.doc[:-1][same]])


def ngram_counts(texts: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Counts by bucket over all rows of texts (text, trusted), and over the trusted ones."""

    def make():
        def step(columns):
            rows, trusted = columns[0], columns[1].to_numpy(zero_copy_only=False)
            for a, b in lexical.chunks(rows):
                bucket, doc = features(rows[a:b], buckets)
                step.total += np.bincount(bucket + buckets * trusted[a:b].astype(np.int64)[doc], minlength=2 * buckets)

        step.total = np.zeros(2 * buckets, np.int64)
        return step

    rest, target = summed_arrays(texts, make, 2 * buckets).reshape(2, buckets)
    return rest + target, target


def log_ratios(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """log p_target - log p_raw of every bucket. trusted: the ids (first column) of the trusted documents.

    The ids are broadcast if they are few enough, else joined by a shuffle."""
    own = narrow(docs, id=id_col, text=text_col)
    ids = settled(positional(trusted).select(F.col("in_0").alias("known")).where("known is not null").distinct())
    marked = own.join(broadcast_checked(ids), F.col("id") == F.col("known"), "left").select("text", F.col("known").isNotNull().alias("trusted"))
    raw, target = ngram_counts(marked, buckets)
    if not target.any():
        return np.zeros(buckets)
    return np.log((target * (raw.sum() / target.sum()) + PSEUDO) / (raw + PSEUDO))


def scorer(spark: SparkSession, ratios: np.ndarray):
    """A column function: text -> mean log ratio (0.0 without n-grams). The table has a fixed size."""
    shared = spark.sparkContext.broadcast(ratios)

    @F.arrow_udf("struct<score: double, n_grams: bigint>")
    def score(texts: pa.Array) -> pa.Array:
        table = shared.value
        scores, sizes = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for a, b in lexical.chunks(texts):
            bucket, doc = features(texts[a:b], len(table))
            sizes[a:b] = n = np.bincount(doc, minlength=b - a)
            scores[a:b] = np.bincount(doc, table[bucket], minlength=b - a) / np.maximum(n, 1)
        trim()
        return pa.StructArray.from_arrays([pa.array(scores), pa.array(sizes)], ["score", "n_grams"])

    return score


def trusted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as good and not toxic."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 and toxic = 0").select("doc_id")


def score_documents(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of docs: doc_id, score (rounded to 6 places), n_grams and keep."""
    spark = docs.sparkSession
    score = scorer(spark, log_ratios(docs, trusted, id_col, text_col, buckets))
    own = narrow(docs, doc_id=id_col, text=text_col)
    scored = own.select("doc_id", score("text").alias("s")).select("doc_id", F.round("s.score", 6).alias("score"), F.col("s.n_grams").alias("n_grams"))
    return scored.withColumn("keep", (F.col("score") >= threshold) & (F.col("n_grams") > 0))


def keep_documents(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their columns, that score_documents keeps."""
    score = scorer(docs.sparkSession, log_ratios(docs, trusted, id_col, text_col, buckets))

    def good(column):
        s = score(column(text_col))
        return (F.round(s["score"], 6) >= threshold) & (s["n_grams"] > 0)

    return keep_where(docs, good)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), trusted_ids(spark, sf_dir))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}]+|[!-/:-@\\[-`{{-~]+') AS w FROM documents),
u AS (SELECT r, doc_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM d WHERE len(w) > 0),
v AS (SELECT w, list_reduce(list_transform(string_split(w, ''), lambda c: unicode(c)::BIGINT), lambda a, b: (a * {BASE} + b) % {PRIME}) AS h FROM (SELECT DISTINCT w FROM u)),
h AS (SELECT r, doc_id, i, h, lead(h) OVER (PARTITION BY r ORDER BY i) AS n FROM u JOIN v USING (w)),
g AS (SELECT r, doc_id, h % {BUCKETS} AS b FROM h UNION ALL SELECT r, doc_id, (h * {PAIR} + n) % {PRIME} % {BUCKETS} FROM h WHERE n IS NOT NULL),
t AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
c AS (SELECT b, count(*) AS raw, count(t.doc_id) AS target FROM g LEFT JOIN t USING (doc_id) GROUP BY b),
p AS (SELECT b, CASE WHEN sum(target) OVER () = 0 THEN 0.0 ELSE ln((target * ((sum(raw) OVER ()) / (sum(target) OVER ())) + {PSEUDO}) / (raw + {PSEUDO})) END AS q FROM c),
s AS (SELECT r, sum(q) / count(*) AS score, count(*) AS n_grams FROM g JOIN p USING (b) GROUP BY r)
SELECT doc_id, round(coalesce(score, 0.0), 6) AS score, coalesce(n_grams, 0)::BIGINT AS n_grams,
       round(coalesce(score, 0.0), 6) >= {THRESHOLD} AND coalesce(n_grams, 0) > 0 AS keep
FROM d LEFT JOIN s USING (r)
"""
