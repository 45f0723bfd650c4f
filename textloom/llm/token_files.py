"""Token ids as flat binary files.

Every partition of the documents becomes a file of unsigned integers (16 bits
if the vocabulary allows, else 32) and a file of 64-bit offsets: where each of
its documents begins, and the end. Where a partition begins among all tokens
and documents comes from prefix sums over the partitions' totals. A reader
maps the files into memory.

The tokenizer is byte-level BPE given by a file of ranks (a base64 token and
its rank a line) and splits texts by PATTERN first. The split is done by array
arithmetic for many texts at once; each distinct piece is encoded once a task
as long as it stays in the cache. Whether a document's tokens have as many
bytes as its text is checked, and where not it is encoded again on its own.

Cases: null and empty texts are documents of no tokens but the end mark (none
if end_id is None). Very long texts are encoded whole. Repeated rows, and rows
of one doc_id, are documents each; null doc_ids stay. Ties don't occur. Without
rows there are no files but an empty list of parts. Extra columns, whatever
their names, play no part.

All files of a call have names that begin with the call's own mark. A task that
runs again writes a file of another name; only those of the attempt that
succeeded are listed, and the call's others are removed. Files of other calls,
and anything else in the folder, are left alone; the list of parts is that of
the call that ended last.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import lexical
from .frames import narrow, new_folder, per_batch, settled

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: An id that the ranks leave free; it ends every document.
END_ID = 50256

OTHER, LETTER, NUMBER, SPACE = range(4)


@functools.cache
def _classes() -> np.ndarray:
    """What each code point is to PATTERN."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            out[i] = LETTER
        elif c == "N":
            out[i] = NUMBER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return out


def piece_starts(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the matches of PATTERN begin in texts codes[bounds[i]:bounds[i + 1]] that follow one another."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[codes]
    new = np.empty(n + 1, bool)
    new[0] = new[n] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:n])
    new[bounds] = True
    text_end = np.zeros(n + 1, bool)
    text_end[bounds] = True
    # The last of the white space before something else in the same text stands alone, or with that if it is a space.
    after = np.flatnonzero(new[1:n] & (kind[: n - 1] == SPACE) & ~text_end[1:n]) + 1
    new[after - 1] = True
    new[after[codes[after - 1] == 32]] = False
    # Contractions: an apostrophe that begins a piece, and the letters after it.
    quote = np.flatnonzero((codes == 39) & new[:n])
    if len(quote):
        padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
        last = bounds[np.searchsorted(bounds, quote, "right")]
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [115, 116, 109, 100]) & (quote + 1 < last)
        two = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & (quote + 2 < last)
        new[quote[one | two] + 1] = False
        new[quote[one] + 2] = True
        new[quote[two] + 3] = True
    return np.flatnonzero(new[:n])


class Encoder:
    """Texts to ids. ranks: path of the file of ranks."""

    SLOTS = 1 << 20
    POOL = 1 << 23

    def __init__(self, ranks: str):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(table.values()) + 1
        self.core = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.bytes_of = np.zeros(self.size, np.int64)
        for token, i in table.items():
            self.bytes_of[i] = len(token)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.where = np.zeros(self.SLOTS, np.int64)
        self.sizes = np.zeros(self.SLOTS, np.int32)
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0

    def encode(self, texts: lexical.Texts) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, and how many each text has."""
        texts = [t or "" for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)]
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=bounds[1:])
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = piece_starts(codes, bounds)
        ends = np.append(starts[1:], len(codes))[: len(starts)]
        where, sizes = self.look_up(joined, lexical.span_hashes(codes, starts, ends), starts, ends)
        ids = self.pool[lexical.ragged(where, sizes)]
        first = np.searchsorted(starts, bounds)
        counts = lexical.sums_by(first, sizes.astype(np.int64))
        # Each text's tokens must have the bytes of the text.
        utf8 = 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(counts)])
        wrong = np.flatnonzero(lexical.sums_by(at, self.bytes_of[ids]) != lexical.sums_by(bounds, utf8.astype(np.int64)))
        if len(wrong):
            parts = np.split(ids, at[1:-1])
            for i in wrong:
                parts[i] = np.array(self.core.encode_ordinary(texts[i]), np.int32)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts

    def look_up(self, joined: str, h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool each piece's ids are, and how many; pieces that are new are encoded."""
        if self.used > self.POOL:
            self.forget()
        h = h | np.uint64(1)  # 0 marks a free slot
        slot = (h >> np.uint64(44)).astype(np.int64)
        where, sizes = self.where[slot], self.sizes[slot]
        missed = np.flatnonzero(self.keys[slot] != h)
        if len(missed):
            _, one, back = np.unique(h[missed], return_index=True, return_inverse=True)
            one = missed[one]
            found = [self.core._encode_single_piece(joined[a:b]) for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
            n = np.array([len(f) for f in found], np.int32)
            total = int(n.sum())
            while self.used + total > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.used : self.used + total] = [i for f in found for i in f]
            begin = self.used + np.cumsum(n) - n
            self.used += total
            self.keys[slot[one]], self.where[slot[one]], self.sizes[slot[one]] = h[one], begin, n
            where[missed], sizes[missed] = begin[back], n[back]
        return where, sizes


SCHEMA = "doc_id bigint, part int, file string, doc_in_part bigint, token_in_part bigint, n_tokens bigint"


def write(docs: DataFrame, folder: str, ranks: str = RANKS, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the texts' ids under folder (a path or URI that all executors and the driver see).

    Returns a row for each document: doc_id, part, doc_no and token_start (places among all documents and
    tokens of all parts), n_tokens (with the end mark)."""
    wide = max(_vocabulary(ranks), (end_id or 0) + 1) > 1 << 16
    kind = np.uint32 if wide else np.uint16
    mark = f"part-{uuid.uuid4().hex}-"

    def make():
        encoder = Encoder(ranks)
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        name = f"{mark}{part:06d}-{uuid.uuid4().hex[:12]}"
        fs, at = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        ids_file, offsets_file = fs.open_output_stream(f"{at}/{name}.bin"), fs.open_output_stream(f"{at}/{name}.idx")
        offsets_file.write(np.zeros(1, np.uint64).tobytes())
        done = {"docs": 0, "tokens": 0}

        def step(columns) -> Iterator[dict]:
            doc_ids, texts = columns[0], columns[1]
            sizes = []
            for a, b in lexical.chunks(texts, 2 * lexical.CHUNK_CHARS):
                ids, n = encoder.encode(texts[a:b])
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(n), end_id)
                    n = n + 1
                ids_file.write(ids.astype(kind).tobytes())
                sizes.append(n)
            sizes = np.concatenate(sizes)
            ends = done["tokens"] + np.cumsum(sizes)
            offsets_file.write(ends.astype(np.uint64).tobytes())
            m = len(texts)
            yield {"doc_id": doc_ids, "part": np.full(m, part, np.int32), "file": [name] * m, "doc_in_part": done["docs"] + np.arange(m), "token_in_part": ends - sizes, "n_tokens": sizes}
            done["docs"] += m
            done["tokens"] = int(ends[-1]) if m else done["tokens"]

        def finish() -> Iterator[dict]:
            ids_file.close()
            offsets_file.close()
            return iter(())

        step.finish = finish
        return step

    rows = settled(per_batch(narrow(docs, id=id_col, text=text_col), make, SCHEMA))
    totals = rows.groupBy("part", "file").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"))
    # A row for each partition: few enough for one task.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", "file", "n_tokens", "n_docs", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base_token"), F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("base_doc"))
    parts = bases.orderBy("part").toPandas()
    fs, at = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(at, recursive=True)
    listed = set(parts["file"])
    for f in fs.get_file_info(pa.fs.FileSelector(at)):
        if f.base_name.startswith(mark) and f.base_name.rsplit(".", 1)[0] not in listed:
            fs.delete_file(f.path)
    table = pa.table({"part": pa.array(parts["part"], pa.int32()), "file": pa.array(parts["file"], pa.string())} | {c: pa.array(parts[c], pa.int64()) for c in ("n_tokens", "n_docs", "base_token", "base_doc")})
    pq.write_table(table.replace_schema_metadata({"dtype": np.dtype(kind).name, "end_id": str(end_id)}), f"{at}/parts.parquet", filesystem=fs)
    base = rows.sparkSession.createDataFrame(parts[["part", "base_token", "base_doc"]].astype("int64"), "part bigint, base_token bigint, base_doc bigint")
    # A row of three numbers for each partition; Spark broadcasts them if they are small enough.
    joined = rows.join(base, rows["part"] == base["part"])
    return joined.select("doc_id", rows["part"], (F.col("base_doc") + F.col("doc_in_part")).alias("doc_no"), (F.col("base_token") + F.col("token_in_part")).alias("token_start"), "n_tokens")


def _vocabulary(ranks: str) -> int:
    with open(ranks, "rb") as f:
        return 1 + max(int(line.split()[1]) for line in f)


class TokenFiles:
    """Documents of a local folder that write() has filled, mapped into memory."""

    def __init__(self, folder: str):
        self.folder = folder.removeprefix("file://")
        table = pq.read_table(f"{self.folder}/parts.parquet")
        meta = table.schema.metadata
        self.kind = np.dtype(meta[b"dtype"].decode())
        self.end_id = None if meta[b"end_id"] == b"None" else int(meta[b"end_id"])
        self.parts = table.to_pylist()
        self.base_doc = np.array([p["base_doc"] for p in self.parts], np.int64)
        self.n_docs = sum(p["n_docs"] for p in self.parts)
        self.n_tokens = sum(p["n_tokens"] for p in self.parts)
        self.ids = [np.memmap(f"{self.folder}/{p['file']}.bin", self.kind, "r") if p["n_tokens"] else np.zeros(0, self.kind) for p in self.parts]
        self.offsets = [np.memmap(f"{self.folder}/{p['file']}.idx", np.uint64, "r") for p in self.parts]

    def __len__(self) -> int:
        return self.n_docs

    def __getitem__(self, doc_no: int) -> np.ndarray:
        """The ids of a document, with the end mark."""
        if not 0 <= doc_no < self.n_docs:
            raise IndexError(doc_no)
        k = int(np.searchsorted(self.base_doc, doc_no, "right")) - 1
        a, b = self.offsets[k][doc_no - self.base_doc[k] : doc_no - self.base_doc[k] + 2]
        return self.ids[k][int(a) : int(b)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "tokens"))
