"""Line dedup over a sharded minimal perfect hash.

1. Each document gives the 128-bit hashes of its distinct long line keys.
2. Spark counts documents and the largest id for each hash (map-side combined).
3. All distinct hashes are dealt to shards. Each shard is one row: a minimal
   perfect hash (levels of bit arrays, rank of the bit is the slot) with a
   fingerprint, a count and a largest-id array.
4. Documents probe the arrays with their hashes, and the count they find there
   tells whether the line repeats; no line text is ever joined.
   Probes go to their shard; hashes that make up over 1/``HOT`` of all probes go
   into one more index, of ``HOT`` keys at most, that every task holds, so a line
   of a third of all documents stays spread over all tasks.
5. What must be dropped comes back as hashes by document, and the lines go.

Defined results: null or empty text is one empty line, kept; a null id counts as
a document and as the smallest id; repeated rows count as so many documents and,
with the largest id, all keep the line; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import NO_ID, ids, longs, mix, texts
from .storage import purge, written

MIN_CHARS = 40
MIN_DOCS = 5
SHARD_KEYS = 250_000
SHARD_PROBES = 1_000_000
HOT = 200_000
_GAMMA = 2.0

INDEX_SCHEMA = "shard int, sizes binary, bits binary, prints binary, counts binary, largest binary"


def line_key(line: bytes) -> bytes:
    """The line without ASCII space at both ends and with A-Z lower-cased."""
    return line.strip().lower()


def long_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of each line, None where it is too short."""
    out: list[bytes | None] = []
    for line in text.split(b"\n"):
        key = line_key(line)
        out.append(key if len(key) >= min_chars and _points(key) >= min_chars else None)
    return out


def _points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _hash(key: bytes) -> tuple[int, int]:
    return divmod(xxhash.xxh3_128_intdigest(key), 1 << 64)


# --- the minimal perfect hash ---------------------------------------------------------------


def _slot(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h1 + np.uint64(2 * level + 1) * h2) % np.uint64(size)).astype(np.int64)


def build_index(h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, largest: np.ndarray) -> dict[str, bytes]:
    """Index over distinct 128-bit hashes: a key that is alone in its slot of a level gets that bit, the others go on."""
    sizes, bits, ranked = [], [], []
    left = np.arange(h1.size)
    while left.size:
        size = max(8, int(_GAMMA * left.size))
        slot = _slot(h1[left], h2[left], len(sizes), size)
        alone = np.bincount(slot, minlength=size) == 1
        mine = alone[slot]
        bits.append(alone)
        sizes.append(size)
        ranked.append(left[mine][np.argsort(slot[mine])])
        left = left[~mine]
    order = np.concatenate(ranked) if ranked else np.zeros(0, np.int64)
    return {
        "sizes": np.array(sizes, np.int64).tobytes(),
        "bits": b"".join(np.packbits(b).tobytes() for b in bits),
        "prints": h2[order].tobytes(),
        "counts": counts[order].astype(np.int64).tobytes(),
        "largest": largest[order].astype(np.int64).tobytes(),
    }


class Index:
    """Probes one shard's arrays."""

    def __init__(self, row: dict):
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        packed, self.bits, at = np.frombuffer(row["bits"], np.uint8), [], 0
        for size in self.sizes:
            n = -(-int(size) // 8)
            self.bits.append(np.unpackbits(packed[at : at + n], count=int(size)).astype(bool))
            at += n
        before = np.cumsum([0, *(int(b.sum()) for b in self.bits)])
        self.rank = [np.cumsum(b) - 1 + n for b, n in zip(self.bits, before)]
        self.prints = np.frombuffer(row["prints"], np.uint64)
        self.counts = np.frombuffer(row["counts"], np.int64)
        self.largest = np.frombuffer(row["largest"], np.int64)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 for those that are not in the index."""
        out = np.full(h1.size, -1, np.int64)
        open_ = np.arange(h1.size)
        for level, size in enumerate(self.sizes):
            slot = _slot(h1[open_], h2[open_], level, int(size))
            hit = self.bits[level][slot]
            out[open_[hit]] = self.rank[level][slot[hit]]
            open_ = open_[~hit]
        found = np.flatnonzero(out >= 0)
        out[found[self.prints[out[found]] != h2[found]]] = -1
        return out


# --- the operator ----------------------------------------------------------------------------


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, h1, h2) of each document's distinct long keys."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            who, first, second = [], [], []
            for i, t in zip(ids(b.column(0)).tolist(), texts(b.column(1))):
                for key in set(long_keys(t, min_chars)) - {None}:
                    h = _hash(key)
                    who.append(i)
                    first.append(h[0])
                    second.append(h[1])
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), longs(np.array(first, np.uint64)), longs(np.array(second, np.uint64))], names=["doc_id", "h1", "h2"])

    return docs.mapInArrow(scan, "doc_id long, h1 long, h2 long")


def _shard_of(n: int):
    return F.pmod(F.col("h1"), F.lit(n)).cast("int").alias("shard")


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    made = build_index(*(pdf[c].to_numpy().view(np.uint64) for c in ("h1", "h2")), pdf["n"].to_numpy(), pdf["largest"].to_numpy())
    return pd.DataFrame([{"shard": pdf["shard"].iloc[0], **made}])


def _prober(min_docs: int):
    def probe(probes: pa.Table, index: pa.Table) -> pa.Table:
        if not index.num_rows or not probes.num_rows:
            return probes.select(["doc_id", "h1"]).slice(0, 0)
        return _dropped(Index(index.drop(["shard"]).to_pylist()[0]), probes, min_docs)

    return probe


def _dropped(index: Index, probes, min_docs: int) -> pa.Table:
    """The probes whose line must go from their document: counted often enough, and kept by another one."""
    who, h1, h2 = (np.asarray(probes.column(c)).astype(np.int64) for c in ("doc_id", "h1", "h2"))
    h1, h2 = h1.view(np.uint64), h2.view(np.uint64)
    slot = index.probe(h1, h2)
    goes = slot >= 0
    goes[goes] = (index.counts[slot[goes]] >= min_docs) & (index.largest[slot[goes]] != who[goes])
    return pa.table({"doc_id": pa.array(who[goes], pa.int64()), "h1": longs(h1[goes])})


def count_lines(lines: DataFrame) -> DataFrame:
    """(h1, h2, n, largest) of each distinct line hash."""
    return lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("largest"))


def repeated_lines(lines: DataFrame, counted: DataFrame, *, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, h1) of the line hashes that a document must lose, from written lines and their counts."""
    spark = lines.sparkSession
    n_keys, n_probes = counted.count(), lines.count()
    # at most HOT keys can each make up 1/HOT of the probes
    hot = counted.filter(F.col("n") > max(n_probes / HOT, 1000)).toPandas()
    cold = counted.filter(F.col("n") <= max(n_probes / HOT, 1000))
    sent = spark.sparkContext.broadcast(build_index(*(hot[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2")), hot["n"].to_numpy(), hot["largest"].to_numpy(np.int64)))
    shards = max(1, -(-n_keys // SHARD_KEYS), -(-n_probes // SHARD_PROBES))
    index = cold.select("*", _shard_of(shards)).groupBy("shard").applyInPandas(_build_shard, INDEX_SCHEMA)

    def hot_probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Index(sent.value)
        for b in batches:
            yield from _dropped(held, b, min_docs).to_batches()

    def not_hot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Index(sent.value)
        for b in batches:
            h1, h2 = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (1, 2))
            yield b.filter(pa.array(held.probe(h1, h2) < 0))

    rest = lines.mapInArrow(not_hot, lines.schema) if len(hot) else lines
    hits = rest.select("*", _shard_of(shards)).groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_prober(min_docs), "doc_id long, h1 long")
    if len(hot):
        hits = hits.unionByName(lines.mapInArrow(hot_probe, "doc_id long, h1 long"))
    return hits


OUT_SCHEMA = "doc_id long, n_lines long, n_dropped long, kept string"


def dedup_lines(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, digest: bool = False
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) of every row: its lines without those that a larger document keeps.

    ``digest`` gives the SHA-256 of the kept text as ``kept_sha256`` in its place.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = written(line_hashes(docs, min_chars), "line-hashes")
    counted = written(count_lines(lines), "line-counts")
    gone = repeated_lines(lines, counted, min_docs=min_docs).groupBy("doc_id").agg(F.collect_set("h1").alias("gone"))
    gone = written(gone, "line-drops").withColumnRenamed("doc_id", "_id")
    for done in (lines, counted):
        purge(docs.sparkSession, done)
    # the same plan at every size: what must go is not bounded, so it isn't broadcast where it happens to be small
    joined = docs.join(gone.hint("merge"), F.coalesce("doc_id", F.lit(NO_ID)) == F.col("_id"), "left").select("doc_id", "text", "gone")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, drops in zip(texts(b.column(1)), b.column(2).to_pylist()):
                lines = text.split(b"\n")
                n_lines.append(len(lines))
                if drops:
                    bad = {x % 2**64 for x in drops}
                    lines = [x for x, k in zip(lines, long_keys(text, min_chars)) if k is None or _hash(k)[0] not in bad]
                n_dropped.append(n_lines[-1] - len(lines))
                out = b"\n".join(lines)
                kept.append(hashlib.sha256(out).hexdigest() if digest else out.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    out = joined.mapInArrow(drop, OUT_SCHEMA)
    return out.withColumnRenamed("kept", "kept_sha256") if digest else out
