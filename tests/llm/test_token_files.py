from __future__ import annotations

import os

import numpy as np
import pytest

from textloom.llm import token_files as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.RANKS), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(T.RANKS)


CASES = ["Hello world", "I'm sure they'll've 'd 's", "  leading and  double   spaces \n\n lines\t\ttabs ", "a1b2 33 3.14", "漢字 and é, ü; Ω", "", " ", "\n", "'", "''s's", "x" * 3000, "don't 'tis 're", " nbsp em", "\U0001f600\U0001f601!", "á combining", "²³ ½ Ⅷ"]


def test_ids_are_the_tokenizers(encoder):
    want = [encoder.core.encode_ordinary(t) for t in CASES]
    ids, n = encoder.encode(CASES)
    at = np.concatenate([[0], np.cumsum(n)])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want


@pytest.mark.parametrize("end_id", [T.END_ID, None])
def test_files_round_trip(spark, clashing, awkward, encoder, tmp_path, end_id):
    rows = [*awkward, *enumerate(CASES, 100)]
    df = clashing(rows).repartition(5)
    got = T.write(df, f"file://{tmp_path}/tokens", end_id=end_id).collect()
    files = T.TokenFiles(f"file://{tmp_path}/tokens")
    assert len(files) == len(got) == len(rows)
    assert files.n_tokens == sum(r.n_tokens for r in got)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    begin = 0
    for r in sorted(got, key=lambda r: r.doc_no):
        assert r.token_start == begin, "places come from prefix sums"
        begin += r.n_tokens
        ids = files[r.doc_no].tolist()
        assert len(ids) == r.n_tokens
        if end_id is not None:
            assert ids.pop() == end_id
        assert encoder.core.decode(ids) in texts[r.doc_id]
    assert sorted(r.doc_no for r in got) == list(range(len(rows)))
    for p in files.parts:
        assert os.path.getsize(f"{files.folder}/{p['file']}.bin") == p["n_tokens"] * files.kind.itemsize
        assert os.path.getsize(f"{files.folder}/{p['file']}.idx") == (p["n_docs"] + 1) * 8
    with pytest.raises(IndexError):
        files[len(rows)]


def test_foreign_files_stay(spark, frame, tmp_path):
    """A folder that holds a table of Spark's and another call's tokens keeps both."""
    folder = tmp_path / "tokens"
    spark.range(50).repartition(3).write.parquet(f"file://{folder}")
    T.write(frame([(1, "a b"), (2, "c")]), f"file://{folder}")
    first = {p["file"] for p in T.TokenFiles(str(folder)).parts}
    before = {f.name for f in folder.iterdir()}
    T.write(frame([(3, "d e f")]), f"file://{folder}")
    names = {f.name for f in folder.iterdir()}
    assert before - {"parts.parquet"} <= names
    files = T.TokenFiles(str(folder))
    assert len(files) == 1 and not first & {p["file"] for p in files.parts}
    (folder / "parts.parquet").unlink()
    assert spark.read.parquet(*[str(f) for f in folder.glob("*.snappy.parquet")]).count() == 50


def test_leftovers_of_the_calls_own_attempts_go(spark, frame, tmp_path, monkeypatch):
    folder = tmp_path / "tokens"
    folder.mkdir()
    mark = "ab" * 16
    monkeypatch.setattr(T.uuid, "uuid4", lambda: type("U", (), {"hex": mark})())
    lost = folder / f"part-{mark}-000000-lost.bin"
    lost.write_bytes(b"1234")
    T.write(frame([(1, "a b")]), f"file://{folder}")
    assert not lost.exists() and len(T.TokenFiles(str(folder))) == 1


def test_empty_table(spark, frame, tmp_path):
    assert T.write(frame([]), f"file://{tmp_path}/none").count() == 0
    assert len(T.TokenFiles(f"{tmp_path}/none")) == 0
