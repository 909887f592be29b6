"""Benchmark decontamination by training suffix arrays.

Every Arrow batch of training documents is one shard. The shard's words become
integer ids over the benchmark's vocabulary (0: any other word); suffixes are
sorted by their first ``window`` words, and test windows are binary-searched
there. The suffixes that begin with a test window, the only ones that can match a
test suffix, are then put in the order of their whole length: the shard's suffix
array. Every test suffix is binary-searched in it by comparing whole suffixes,
which gives its longest verbatim match in the shard and where that is. What is hit
follows from the equal ranges of the windows alone, so work follows the number of
places in the shard and in the test set, never their product. No row is shuffled.

The test set is sent to the executors in slices of at most ``slice_bytes`` of
text. Each slice is a pass of its own over the training data that writes the few
documents it hits and is then taken back from the executors, so what is held at
once never grows with either table; the slices' results are merged by document.

Defined results: null or empty text has no words, is never hit and hits nothing;
an item shorter than ``window`` is one window of its own length; item ids may be
of any type and are told as strings; repeated rows are judged one by one; an item
without id marks words but is not listed; an empty benchmark hits nothing. Columns
besides id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import unused, written

WINDOW = 10
SLICE_BYTES = 16 << 20
_SHARD = 512

_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

_MATCH = "struct<item_id:string,item_start:int,doc_start:int,length:int>"
FOUND = f"hit_words array<int>, item_ids array<string>, matches array<{_MATCH}>"


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_FOLD).split()


class TestIndex:
    """Vocabulary, words and windows of one slice of the test set."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.window = window
        self.item_ids = [i for i, _ in items]
        texts = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(t)], np.uint32) for _, t in items]
        self.words, self.begins = _laid_out(texts, window)
        sizes = np.array([t.size for t in texts], np.int64)
        # for each window length: the distinct windows as padded keys, their places, and the items that hold each
        self.by_size = []
        for size in np.unique(np.minimum(sizes[sizes > 0], window)).tolist():
            held = np.flatnonzero(np.minimum(sizes, window) == size)
            many = sizes[held] - size + 1
            places = np.repeat(self.begins[held] - np.cumsum(many) + many, many) + np.arange(many.sum())
            keys = np.zeros((places.size, window), dtype=">u4")
            keys[:, :size] = self.words[places[:, None] + np.arange(size)]
            low, which = np.unique(_keys(keys), return_inverse=True)
            high = low
            if size < window:
                last = low.view(">u4").reshape(-1, window).copy()
                last[:, size:] = 0xFFFFFFFF
                high = _keys(last)
            owner = np.unique(which * np.int64(len(items)) + np.repeat(held, many))
            owners, edge = owner % len(items), np.searchsorted(owner // len(items), np.arange(low.size + 1))
            self.by_size.append((size, low, high, places, which, owners, edge))
        self._told: dict[bytes, list[str]] = {}

    def _suffixes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first words, places) of the suffixes that stay in the vocabulary for the shortest window, in the words' order."""
        stop, live = np.flatnonzero(ids == 0), np.flatnonzero(ids)
        least = self.by_size[0][0] if self.by_size else 1
        start = live[stop[np.searchsorted(stop, live)] - live >= least]
        keys = _keys(ids[start[:, None] + np.arange(self.window)].astype(">u4"))
        order = np.argsort(keys, kind="stable")
        return keys[order], start[order]

    def _occurrences(self, ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(number of the window length, length, windows, places), one for each time that a test window occurs, and what was searched."""
        keys, places = self._suffixes(ids)
        if not places.size:
            return
        for n, (size, low, high, *_) in enumerate(self.by_size):
            left, right = np.searchsorted(keys, low, "left"), np.searchsorted(keys, high, "right")
            many = right - left
            if many.any():
                at = np.repeat(left - np.cumsum(many) + many, many) + np.arange(many.sum())
                yield n, size, np.repeat(np.arange(low.size), many), places[at], keys[at], at

    def _ids(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        get = self.vocab.get
        return _laid_out([np.fromiter((get(x, 0) for x in words), np.uint32, len(words)) for words in docs], self.window)

    def touched(self, docs: list[list[bytes]]) -> np.ndarray:
        """Whether each document holds a test window."""
        ids, begins = self._ids(docs)
        out = np.zeros(len(docs), bool)
        for _, _, _, spots, *_ in self._occurrences(ids):
            out[np.searchsorted(begins, spots, "right") - 1] = True
        return out

    def search(self, docs: list[list[bytes]]) -> tuple[list[np.ndarray], list[list[str]], list[list[tuple]]]:
        """For each document the words that are hit, the items that hit it, and the longest matches that are in it."""
        ids, begins = self._ids(docs)
        cover = np.zeros(ids.size + 1, np.int64)
        windows: list[list[bytes]] = [[] for _ in docs]
        keys, places, rank = [np.zeros(0, f"S{4 * self.window}")], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, size, which, spots, first, at in self._occurrences(ids):
            np.add.at(cover, spots, 1)
            np.add.at(cover, spots + size, -1)
            pair = np.unique(np.column_stack([np.searchsorted(begins, spots, "right") - 1, which]), axis=0)
            for d, w in pair.tolist():
                windows[d].append(n.to_bytes(2, "big") + w.to_bytes(8, "big"))
            keys.append(first)
            places.append(spots)
            rank.append(at)
        hit = np.cumsum(cover) > 0
        once = np.unique(np.concatenate(rank), return_index=True)[1]
        found: list[list[tuple]] = [[] for _ in docs]
        if once.size:
            for start, place, length in zip(*self._longest(ids, np.concatenate(keys)[once], np.concatenate(places)[once])):
                d, item = np.searchsorted(begins, place, "right") - 1, np.searchsorted(self.begins, start, "right") - 1
                found[d].append((self.item_ids[item], int(start - self.begins[item]), int(place - begins[d]), int(length)))
        return [np.flatnonzero(hit[b : b + len(words)]) for b, words in zip(begins.tolist(), docs)], [self._items(b"".join(w)) for w in windows], found

    def _items(self, windows: bytes) -> list[str]:
        """The ids of the items that hold one of the windows, in order; worked out once for documents with the same windows."""
        if windows not in self._told:
            if len(self._told) > 1000:
                self._told.clear()
            items = set()
            for at in range(0, len(windows), 10):
                *_, owners, edge = self.by_size[int.from_bytes(windows[at : at + 2], "big")]
                w = int.from_bytes(windows[at + 2 : at + 10], "big")
                items.update(owners[edge[w] : edge[w + 1]].tolist())
            self._told[windows] = sorted({self.item_ids[i] for i in items} - {None})
        return self._told[windows]

    def _longest(self, ids: np.ndarray, keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the test set, place in the shard, length) of the longest match of each test suffix that isn't the rest of one a word longer."""
        array = places[_whole_order(ids, keys, places, self.window)]
        starts, low_at, high_at, least = [], [], [], []
        for size, low, high, mine, which, *_ in self.by_size:
            left, right = np.searchsorted(keys, low, "left")[which], np.searchsorted(keys, high, "right")[which]
            some = right > left
            starts.append(mine[some])
            low_at.append(left[some])
            high_at.append(right[some])
            least.append(np.full(int(some.sum()), size))
        starts, first, last, least = map(np.concatenate, (starts, low_at, high_at, least))
        low, high = first.copy(), last.copy()
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            same = self._common(ids, starts[open_], array[mid], least[open_])
            after = self.words[starts[open_] + same] > ids[array[mid] + same]
            low[open_[after]] = mid[after] + 1
            high[open_[~after]] = mid[~after]
        # the longest match is beside the place where the suffix belongs
        best, where = np.zeros(starts.size, np.int64), np.zeros(starts.size, np.int64)
        for beside in (low, low - 1):
            inside = np.flatnonzero((beside >= first) & (beside < last))
            same = self._common(ids, starts[inside], array[beside[inside]], least[inside])
            longer = same > best[inside]
            best[inside[longer]], where[inside[longer]] = same[longer], array[beside[inside[longer]]]
        length = np.zeros(self.words.size, np.int64)
        length[starts] = best
        new = length[starts - 1] != best + 1
        return starts[new], where[new], best[new]

    def _common(self, ids: np.ndarray, mine: np.ndarray, theirs: np.ndarray, known: np.ndarray) -> np.ndarray:
        """How many words the suffixes share, at least the known ones."""
        length, going = known.copy(), np.arange(mine.size)
        while going.size:
            x, y = self.words[mine[going] + length[going]], ids[theirs[going] + length[going]]
            going = going[(x == y) & (x != 0)]
            length[going] += 1
        return length


def _whole_order(ids: np.ndarray, keys: np.ndarray, places: np.ndarray, window: int) -> np.ndarray:
    """The order of whole suffixes, given in the order of their first ``window`` words: ties are compared by the next words."""
    rank = np.cumsum(np.r_[False, keys[1:] != keys[:-1]])
    at = window
    ended = (ids[places[:, None] + np.arange(window)] == 0).any(axis=1)
    while True:
        many = np.bincount(rank)
        tied = np.flatnonzero((many[rank] > 1) & ~ended)
        if not tied.size:
            return np.argsort(rank, kind="stable")
        # what comes after the end of a suffix doesn't count
        spots = np.minimum(places[tied][:, None] + at + np.arange(window), ids.size - 1)
        more = ids[spots]
        more[np.cumsum(more == 0, axis=1) > 0] = 0
        part = np.unique(_keys(more.astype(">u4")), return_inverse=True)[1] + 1
        fine = np.zeros(places.size, np.int64)
        fine[tied] = part
        rank = np.unique(rank * np.int64(part.max() + 1) + fine, return_inverse=True)[1]
        ended[tied] = more[:, -1] == 0
        at += window


def _laid_out(texts: list[np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, ids of 0 before, between and after them so that no match crosses, and where each begins."""
    gap = np.zeros(window, np.uint32)
    sizes = np.array([t.size + window for t in texts], np.int64)
    return np.concatenate([gap, *(part for t in texts for part in (t, gap))]), window + np.cumsum(sizes) - sizes


def _keys(matrix: np.ndarray) -> np.ndarray:
    """Rows of big-endian ids as byte strings, which sort as the rows do."""
    return np.ascontiguousarray(matrix).view(f"S{4 * matrix.shape[1]}").ravel()


# --- Spark ------------------------------------------------------------------------------------------


def _slices(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> list[DataFrame]:
    """The test set in slices of about ``limit`` bytes of text."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-2 * total // limit))
    if n == 1:
        return [rows]
    cut = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    return [rows.filter(cut == i) for i in range(n)]


def _sent(part: DataFrame, window: int):
    return part.sparkSession.sparkContext.broadcast(TestIndex([(r[0], (r[1] or "").encode()) for r in part.collect()], window))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for at in range(0, big.num_rows, _SHARD):
            yield big.slice(at, _SHARD)


def _documents(batch: pa.RecordBatch, name: str) -> list[list[bytes]]:
    return [words_of(t or b"") for t in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def _text_hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(3), text), F.xxhash64(F.lit(4), text)


def _matcher(sent, only_hit: bool, carried: list[str]):
    """Rows of the carried columns, ``n_words`` and what :data:`FOUND` names."""
    match = pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _shards(batches):
            docs = _documents(batch, "text")
            hit, items, matches = sent.value.search(docs)
            kept = [d for d, h in enumerate(hit) if h.size or not only_hit]
            told = [[dict(zip(("item_id", "item_start", "doc_start", "length"), m)) for m in matches[d]] for d in kept]
            arrays = [batch.column(batch.schema.get_field_index(c)).take(pa.array(kept, pa.int64())) for c in carried]
            arrays += [pa.array([len(docs[d]) for d in kept], pa.int64()), pa.array([hit[d].astype(np.int32) for d in kept], pa.list_(pa.int32()))]
            arrays += [pa.array([items[d] for d in kept], pa.list_(pa.string())), pa.array(told, pa.list_(match))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carried, "n_words", "hit_words", "item_ids", "matches"])

    return find


def find_matches(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """(doc_id, n_words, hit_words, item_ids, matches) of every row.

    ``matches`` are the longest matches of test suffixes in a shard of documents, told at the document that holds them
    (one of them, where several hold it).
    """
    slices = _slices(benchmark, item_col, item_text, slice_bytes)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if len(slices) == 1:
        return docs.mapInArrow(_matcher(_sent(slices[0], window), False, ["doc_id"]), f"doc_id long, n_words long, {FOUND}")
    h1, h2 = _text_hashes(F.coalesce("text", F.lit("")))
    keyed = docs.select("doc_id", h1.alias("h1"), h2.alias("h2"), "text")
    hits = None
    for part in slices:
        sent = _sent(part, window)
        some = keyed.mapInArrow(_matcher(sent, True, ["doc_id", "h1", "h2"]), f"doc_id long, h1 long, h2 long, n_words long, {FOUND}")
        some = written(some.drop("n_words").distinct(), "decontam-hits")
        sent.unpersist()
        hits = some if hits is None else hits.unionByName(some)
    merged = hits.groupBy(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2")).agg(
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hit_words", "item_ids", "matches"))
    )
    rows = keyed.select("doc_id", "h1", "h2", F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    kinds = [c.strip().split(" ", 1) for c in FOUND.split(", ")]
    return rows.join(merged, same, "left").select("doc_id", "n_words", *(F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in kinds))


def decontaminate(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Documents without a single verbatim window of the benchmark, all their columns kept."""
    slices = _slices(benchmark, item_col, item_text, slice_bytes)
    if len(slices) == 1:
        sent = _sent(slices[0], window)

        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _shards(batches):
                yield batch.filter(pa.array(~sent.value.touched(_documents(batch, text_col))))

        return documents.mapInArrow(clean, documents.schema)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    h1, h2 = _text_hashes(text)
    n1, n2 = unused(documents, "_fw_h1"), unused(documents, "_fw_h2")
    keyed = documents.select(h1.alias(n1), h2.alias(n2), text.alias("text"))
    hits = None
    for part in slices:
        sent = _sent(part, window)

        def touched(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in _shards(batches):
                yield batch.filter(pa.array(sent.value.touched(_documents(batch, "text")))).select([n1, n2])

        some = written(keyed.mapInArrow(touched, f"{n1} long, {n2} long").distinct(), "decontam-touched")
        sent.unpersist()
        hits = some if hits is None else hits.unionByName(some)
    return documents.join(hits, (h1 == F.col(n1)) & (h2 == F.col(n2)), "left_anti")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, from :func:`find_matches`."""
    return found.select(
        "doc_id", "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )
