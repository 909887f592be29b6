"""Substring dedup by Rabin-Karp hashes of fixed-length word windows.

A rolling polynomial hash of every window of ``window`` consecutive words that can
repeat is counted in Spark, which gives the first document of each; every
occurrence but the earliest is covered by removal intervals, merged to maximal ones.

Only windows that can repeat are sent over the network. Within a window the
5-word gram with the least hash is its anchor; equal windows have equal anchors
at equal offsets, so a window whose anchor occurs in one place of one text only is
unique (lossless). Only the anchors, about one in nine positions, are written and
counted first, by text; then the windows over repeated anchors are hashed.

Copies of a text are settled by the text's 128-bit hash: each window of a copy
starts earlier in the copy with the smallest id. Among the other documents a batch
settles its own repeats and sends one occurrence, its earliest, of each window
hash. Steps are written and dropped when the next one stands.

Defined results: null or empty text has no words; texts under ``window`` words
lose none; documents with a null id sort before all others, among themselves by
a hash of their text; rows that repeat an id and text share their place in the
order, so neither removes the other's windows at the same start (an id is taken
to name one text); an empty table gives no rows. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import NO_ID, ids, longs, mix, texts
from .storage import purge, written

WINDOW = 20
GRAM = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of each run of ``width`` values, by doubling the length."""
    n = h.size - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, length, power = None, 0, _BASE
    part, size = h, 1
    while True:
        if width & size:  # append this power-of-two block
            if out is None:
                out, length = part, size
            else:
                m = min(out.size, part.size - length)
                out, length = out[:m] * power + part[length : length + m], length + size
        if 2 * size > width:
            break
        part = part[:-size] * power + part[size:]
        size, power = 2 * size, np.uint64(int(power) ** 2 % 2**64)
    return mix(out[:n])


def _anchors(h: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each gram, and for each window the position of its least gram (the leftmost of equals)."""
    grams = rolling(h, gram)
    span = window - gram + 1
    # sliding minimum by doubling, over (hash, position)
    best, size = np.arange(grams.size), 1
    while 2 * size <= span:
        a, b = best[:-size], best[size:]
        best, size = np.where(grams[b] < grams[a], b, a), 2 * size
    n = h.size - window + 1
    a, b = best[:n], best[span - size : span - size + n]
    return grams, np.where(grams[b] < grams[a], b, a)


def _scan_anchors(window: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1000):
                b = big.slice(at, 1000)
                who, key, pos = [], [], []
                for i, t in zip(ids(b.column(0)).tolist(), texts(b.column(1))):
                    words = t.split()
                    if len(words) < window:
                        continue
                    grams, of_window = _anchors(word_hashes(words), window, gram)
                    spots = of_window[np.r_[True, of_window[1:] != of_window[:-1]]]
                    who.append(np.full(spots.size, i, np.int64))
                    key.append(grams[spots])
                    pos.append(spots)
                empty = np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [longs(np.concatenate([empty, *who])), longs(np.concatenate([empty.view(np.uint64), *key])), pa.array(np.concatenate([empty, *pos]).astype(np.int32))],
                    names=["h1", "anchor", "pos"],
                )

    return scan


#: In place of starts: every window of the document starts earlier, in a copy.
_ALL = -1


def _scan_windows(window: int, gram: int):
    """Of (key, text, first, spots): a row (key, w, start) for the batch's earliest occurrence of each window
    over a repeated anchor, and for each document a row (key, starts) of those known to start earlier."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 2000):
                b = big.slice(at, 2000)
                who, key, pos = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                known: list[tuple[int, list[int]]] = []
                for i, t, first, spots in zip(ids(b.column(0)).tolist(), texts(b.column(1)), ids(b.column(2)).tolist(), b.column(3).to_pylist()):
                    if i != first:
                        known.append((i, [_ALL]))
                        continue
                    h = word_hashes(t.split())
                    if h.size < window or not spots:
                        continue
                    repeated = np.zeros(h.size, bool)
                    repeated[spots] = True
                    start = np.flatnonzero(repeated[_anchors(h, window, gram)[1]])
                    who.append(np.full(start.size, i, np.int64))
                    key.append(rolling(h, window)[start])
                    pos.append(start)
                who, key, pos = np.concatenate(who), np.concatenate(key), np.concatenate(pos)
                order = np.lexsort((pos, who, key))
                who, key, pos = who[order], key[order], pos[order]
                new = np.r_[True, key[1:] != key[:-1]][: key.size]
                lead = np.flatnonzero(new)[np.cumsum(new) - 1] if key.size else order
                late = (who != who[lead]) | (pos != pos[lead])
                by_doc = np.argsort(who[late], kind="stable")
                late_who, late_pos = who[late][by_doc], pos[late][by_doc]
                names, begin = np.unique(late_who, return_index=True)
                known += zip(names.tolist(), (x.tolist() for x in np.split(late_pos, begin[1:])))
                n, m = int((~late).sum()), len(known)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[who[~late], np.array([k for k, _ in known], np.int64)], pa.int64()),
                        longs(np.r_[key[~late], np.zeros(m, np.uint64)]),
                        pa.array(np.r_[pos[~late], np.zeros(m, np.int64)].astype(np.int32)),
                        pa.array([None] * n + [x for _, x in known], pa.list_(pa.int32())),
                    ],
                    names=["key", "w", "start", "starts"],
                )

    return scan


def later_windows(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, starts) of the windows of each document (key, text) that also start earlier; one start of -1: all."""
    spark = docs.sparkSession
    docs = docs.select("key", "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    anchors = docs.select("h1", "text").mapInArrow(_scan_anchors(window, gram), "h1 long, anchor long, pos int")
    anchors = written(anchors, "window-anchors")
    # once in one text, however many copies it has, is not repeated
    place = F.xxhash64("h1", "pos")
    repeated = anchors.groupBy("anchor").agg(F.min(place).alias("a"), F.max(place).alias("b")).filter("a < b")
    # written, so that the join below has plain sides and a common anchor can be split
    repeated = written(repeated.select(F.col("anchor").alias("k")), "window-repeats")
    spots = anchors.join(repeated, anchors.anchor == repeated.k).groupBy("h1").agg(F.collect_set("pos").alias("spots"))
    spots = written(spots, "window-spots")
    purge(spark, anchors)
    texts_once = docs.groupBy("h1", "h2").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    marks = texts_once.join(spots, "h1", "left").filter("spots is not null or first < last").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "first", "spots")
    marks = written(marks, "window-marks")
    purge(spark, spots)
    joined = docs.join(marks, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).select("key", "text", "first", "spots")
    rows = written(joined.mapInArrow(_scan_windows(window, gram), "key long, w long, start int, starts array<int>"), "window-rows")
    purge(spark, marks)
    counted = rows.filter("starts is null").select("key", "w", "start")
    # combined on the map side, and joined back to plain rows, so that a common window can be split
    firsts = counted.groupBy("w").agg(F.min("key").alias("first"), F.max("key").alias("last")).filter("first < last")
    firsts = written(firsts.select(F.col("w").alias("_w"), "first"), "window-firsts")
    later = counted.join(firsts, F.col("w") == F.col("_w")).filter("key > first").select("key", F.array("start").alias("starts"))
    later = later.unionByName(rows.filter("starts is not null").select("key", "starts"))
    return later.groupBy("key").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def removal_intervals(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal intervals (begin, end) of words that windows at these starts cover."""
    starts = np.sort(starts)
    if not starts.size:
        return []
    cut = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, starts.size - 1]] + window).tolist()))


def dedup_substrings(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, digest: bool = False
) -> DataFrame:
    """(doc_id, n_words, n_removed, intervals, kept) of every row; kept words are joined by one space.

    ``digest`` gives the SHA-256 of the kept text as ``kept_sha256`` in its place.
    """
    if not 1 <= gram <= window:
        raise ValueError("gram must be 1 to window")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    nameless = F.lit(NO_ID) + F.pmod(F.xxhash64("text"), F.lit(2**62))
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", nameless).alias("key"))
    later = written(later_windows(docs.select("key", "text"), window=window, gram=gram), "window-drops").withColumnRenamed("key", "_id")
    joined = docs.join(later, F.col("key") == F.col("_id"), "left").select("doc_id", "text", "starts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            n_words, n_removed, spans, kept = [], [], [], []
            for text, starts in zip(texts(b.column(1)), b.column(2).to_pylist()):
                words = text.split()
                n_words.append(len(words))
                # a row that repeats another's id with a shorter text holds fewer windows
                found = [s for s in starts or () if s + window <= len(words)]
                if _ALL in found:
                    found = range(len(words) - window + 1)
                gone = removal_intervals(np.array(found, np.int64), window)
                spans.append([{"begin": x, "end": y} for x, y in gone])
                if gone:
                    edge = [0, *(e for x in gone for e in x), len(words)]
                    words = [w for x, y in zip(edge[::2], edge[1::2]) for w in words[x:y]]
                n_removed.append(n_words[-1] - len(words))
                out = b" ".join(words)
                kept.append(hashlib.sha256(out).hexdigest() if digest else out.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())],
                names=["doc_id", "n_words", "n_removed", "intervals", "kept"],
            )

    out = joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, intervals array<struct<begin:int,end:int>>, kept string")
    return out.withColumnRenamed("kept", "kept_sha256") if digest else out
