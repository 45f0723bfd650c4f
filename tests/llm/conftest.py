from __future__ import annotations

import pytest

@pytest.fixture(autouse=True)
def few_partitions(spark):
    """The corpus operators shuffle often and these tables are small."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of (doc_id, text) as a table of documents."""

    def make(rows):
        full = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def clashing(spark):
    """The same with extra columns whose names clash with those inside the operators."""
    extra = ["in_0", "in_1", "DOC_ID2", "id", "score", "fp", "marked", "again", "pattern", "place", "copy", "shard", "hash", "n_tokens", "__in_0", "known", "trusted", "part"]

    def make(rows):
        full = [(i, t, "en", "src0", len(t) if t is not None else None, *([7] * len(extra))) for i, t in rows]
        return spark.createDataFrame(full, DOCS + "".join(f", `{e}` int" for e in extra))

    return make


@pytest.fixture(scope="session")
def awkward():
    """Rows with nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977} x{i}" for i in range(60_000))
    prose = "the quick brown fox jumps over the lazy dog and runs away from the old farm house near the river"
    return [(None, prose), (1, None), (2, ""), (3, "   \n "), (4, "!!! ... ???"), (5, long), (6, prose), (6, prose), (7, prose + " today"), (8, "a"), (8, "a"), (9, "é ü 漢字 Ω \U0001f600")]
