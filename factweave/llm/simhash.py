"""SimHash near-duplicate groups with pigeonring filtering.

Fingerprints of whole texts are reduced to the distinct ones before any search,
so exact copies cost one row each and never meet in pairs. With at most three
differing bits over a ring of eight 8-bit segments, some start of the ring has
every chain of ``l`` consecutive segments within ``floor(3 * l / 8)`` differing
bits: the first two segments agree, the next three differ in one bit at most (so
two of those three agree), and so on. That gives 24 keys of 32 agreeing bits for
a fingerprint, whose buckets stay near one row up to billions of fingerprints.
Candidates of a bucket, of whatever size, must hold the chain budgets from their
key's start, the last of which is the full Hamming check. Buckets over ``RUN`` rows
hand out a spanning forest of those links, found by breadth-first search, instead of all pairs; buckets over
``LARGE`` rows are split by the bits that vary in them first. Connectivity loses
nothing. Components come from alternating large-star and small-star rounds
with every round written to the shared folder.

Defined results: null or empty text has fingerprint zero and links like any
other; fewer words than the shingle width are one shingle; a null id takes part
but is no group's smallest id unless no other id is there (then null); repeated
rows share their group; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import longs, texts
from .components import connected_components
from .storage import purge, unused, written

WIDTH = 3
DISTANCE = 3
SEGMENTS = 8
RUN = 64
LARGE = 4096
FEW_BITS = 14
#: Bytes of a text that are taken at once.
PIECE = 1 << 20
_BLANK = re.compile(rb"[ \t-\r]")

#: For each byte value eight byte-wide counters, one for each of its bits.
_LANES = np.array([sum(((v >> j) & 1) << (8 * j) for j in range(8)) for v in range(256)], dtype=np.uint64)


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some ``PIECE`` bytes at a time."""
    at = 0
    while len(text) - at > PIECE:
        end = _BLANK.search(text, at + PIECE)
        if end is None:
            break
        yield text[at : end.start()].lower().split()
        at = end.start()
    yield text[at:].lower().split()


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The 64-bit SimHash over word shingles, repeats included; zero without words."""
    ones, total, words = np.zeros(64, np.int64), 0, []
    for piece in _pieces(text):
        words = words[len(words) - width + 1 :] + piece if total else words + piece
        n = len(words) - width + 1
        if n > 0:
            ones += _ones(map(b" ".join, zip(*(words[i:] for i in range(width)))), n)
            total += n
    if not total:
        if not words:
            return 0
        ones, total = _ones([b" ".join(words)], 1), 1
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _ones(shingles: Iterable[bytes], n: int) -> np.ndarray:
    """How often each bit is set in the shingles' hashes."""
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    lanes = _LANES[hashes.view(np.uint8).reshape(n, 8)]
    # byte-wide counters hold 255 rows each
    return np.add.reduceat(lanes, np.arange(0, n, 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def fingerprints(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, row: Column | None = None) -> DataFrame:
    """(doc_id, fingerprint as a signed long) of every row, and the long ``row`` if it is given."""
    carried = [] if row is None else ["row"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t, width) for t in texts(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), longs(prints), *b.columns[2:]], names=["doc_id", "fp", *carried])

    columns = [F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")] + ([] if row is None else [row.alias("row")])
    return documents.select(*columns).mapInArrow(scan, ", ".join(f"{c} long" for c in ("doc_id", "fp", *carried)))


def ring_keys() -> list[tuple[int, tuple[int, ...]]]:
    """(start, the four segments that must agree) of each of the 24 keys."""
    out = []
    for i in range(SEGMENTS):
        for skip in (2, 3, 4):
            out.append((i, tuple((i + j) % SEGMENTS for j in range(5) if j != skip)))
    return out


@cache
def chain_masks(distance: int) -> tuple[np.ndarray, list[int]]:
    """For each start the bits of the longest chain under each budget, and the budgets; shorter chains hold if it does."""
    budgets = [distance * n // SEGMENTS for n in range(1, SEGMENTS + 1)]
    longest = {b: n for n, b in enumerate(budgets, 1)}
    masks = [[sum(0xFF << 8 * ((i + j) % SEGMENTS) for j in range(n)) for n in longest.values()] for i in range(SEGMENTS)]
    return np.array(masks, np.uint64), list(longest)


def chains_hold(diff: np.ndarray, start: np.ndarray | int, distance: int = DISTANCE) -> np.ndarray:
    """Places where every chain from ``start`` keeps its proportional budget; survivors only go on to longer chains, the last is the full check."""
    masks, budgets = chain_masks(distance)
    alive = np.arange(diff.size)
    for j, budget in enumerate(budgets):
        mask = masks[start, j] if np.ndim(start) == 0 else masks[start[alive], j]
        alive = alive[np.bitwise_count(diff[alive] & mask) <= budget]
    return alive


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys = ring_keys()
    for big in batches:
        for at in range(0, big.num_rows, 8192):
            fp = big.slice(at, 8192).column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            seg = [(fp >> np.uint64(8 * i)) & np.uint64(0xFF) for i in range(SEGMENTS)]
            out = []
            for n, (_, parts) in enumerate(keys):
                key = np.full(fp.size, n, np.uint64)
                for p in parts:
                    key = (key << np.uint64(8)) | seg[p]
                out.append(key)
            yield pa.RecordBatch.from_arrays([longs(np.concatenate(out)), longs(np.tile(fp, len(keys)))], names=["bucket", "fp"])


def _forest(run: np.ndarray, start: int, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links among the fingerprints of one large bucket."""
    left, right = [], []
    rest = run
    while rest.size:
        front, rest = [rest[0]], rest[1:]
        while front and rest.size:
            f = front.pop()
            near = chains_hold(rest ^ f, start, distance)
            if near.size:
                found = rest[near]
                left.append(np.full(found.size, f))
                right.append(found)
                front.extend(found)
                rest = np.delete(rest, near)
    return left, right


def _refined(run: np.ndarray, start: int, distance: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of one large bucket that connect what its links connect, without comparing all of it with all.

    The bits that vary in the bucket are cut into ``distance + 1`` groups; linked fingerprints agree in one of them at
    least, so the bucket is split by each group in turn until a part is small or few bits are left.
    """
    free = np.bitwise_or.reduce(run ^ run[0])
    if run.size <= LARGE or int(np.bitwise_count(free)) <= FEW_BITS:
        return _forest(run, start, distance)
    left, right = [], []
    bits = [np.uint64(1 << i) for i in range(64) if int(free) >> i & 1]
    for group in np.array_split(np.array(bits, np.uint64), distance + 1):
        mask = np.bitwise_or.reduce(group)
        part = run[np.argsort(run & mask, kind="stable")]
        key = part & mask
        edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        size = np.diff(edge)
        for j in np.flatnonzero(size > RUN):
            a, b = _refined(part[edge[j] : edge[j + 1]], start, distance)
            left += a
            right += b
        short = np.repeat((size > 1) & (size <= RUN), size)
        key, part = key[short], part[short]
        for i, j in _same_key(key):
            near = chains_hold(part[i] ^ part[j], start, distance)
            left.append(part[i][near])
            right.append(part[j][near])
    return left, right


def _same_key(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of rows with one key, the rows sorted by key."""
    shift = 1
    while key.size > shift:
        same = np.flatnonzero(key[shift:] == key[:-shift])
        if not same.size:
            break
        yield same, same + shift
        shift += 1


def _links_of(key: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key: all pairs in short runs, a spanning forest in long ones."""
    left, right = [], []
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(edge)
    starts = np.array([i for i, _ in ring_keys()])[(key >> np.uint64(32)).astype(np.int64)]
    for j in np.flatnonzero(size > RUN):
        a, b = _refined(fp[edge[j] : edge[j + 1]], int(starts[edge[j]]), distance)
        left += a
        right += b
    short = np.repeat((size > 1) & (size <= RUN), size)
    key, fp, starts = key[short], fp[short], starts[short]
    for i, j in _same_key(key):
        near = chains_hold(fp[i] ^ fp[j], starts[i], distance)
        left.append(fp[i][near])
        right.append(fp[j][near])
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _linker(distance: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        pending: list[tuple[np.ndarray, np.ndarray]] = []

        def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = _links_of(k, f, distance)
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_arrays([longs(np.minimum(a, b)), longs(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k, f = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            if held_k.size and held_k[-1] == k[-1]:  # the whole batch goes on with the held run
                pending.append((k, f))
                continue
            k, f = np.concatenate([held_k, *(x for x, _ in pending), k]), np.concatenate([held_f, *(x for _, x in pending), f])
            pending = []
            last = np.searchsorted(-(k != k[-1]).astype(np.int8), 0)  # where the last run begins
            yield out(k[:last], f[:last])
            held_k, held_f = k[last:], f[last:]
        yield out(np.concatenate([held_k, *(x for x, _ in pending)]), np.concatenate([held_f, *(x for _, x in pending)]))

    return link


def near_links(prints: DataFrame, *, distance: int = DISTANCE) -> DataFrame:
    """Links (a < b) among distinct fingerprints ``fp`` that connect all with ``distance`` or fewer differing bits."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"distance must be 0 to {DISTANCE}")
    rows = prints.select("fp").mapInArrow(_expand, "bucket long, fp long")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "fp")
    return rows.mapInArrow(_linker(distance), "a long, b long").distinct()


def _roots(distinct: DataFrame, distance: int) -> DataFrame:
    """The rows of ``distinct``, a written table that goes, with the root of their fingerprint's group."""
    links = written(near_links(distinct, distance=distance), "simhash-links")
    roots = connected_components(links)
    named = written(distinct.join(roots, distinct.fp == roots.node, "left").select(*distinct.columns, F.coalesce("root", "fp").alias("root")), "simhash-roots")
    for done in (links, roots, distinct):
        purge(named.sparkSession, done)
    return named


def near_groups(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id of its group."""
    prints = written(fingerprints(documents, id_col=id_col, text_col=text_col, width=width), "simhash-prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    named = _roots(distinct, distance)
    # written, so that the join on a large group's root has plain sides and can be split
    least = written(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    of_print = named.join(least, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """One document of each group, all its columns kept: the smallest id, nulls last, then the least hash of text and row.

    The fingerprint row itself names the survivor, so rows with one id or none
    are told apart by their text; repeated rows leave one row.
    """
    hashed = [F.col(f.name) for f in documents.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    row = F.xxhash64(F.lit(29), F.col(text_col), *hashed)
    prints = written(fingerprints(documents, id_col=id_col, text_col=text_col, width=width, row=row), "simhash-prints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")).alias("first")
    named = _roots(written(prints.groupBy("fp").agg(first), "simhash-distinct"), distance)
    own, its_id, its_row = (unused(documents, c) for c in ("_fw_row", "_fw_id", "_fw_of"))
    staying = named.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(its_id), F.col("first.row").alias(its_row))
    rows = documents.withColumn(own, row)
    kept = rows.join(staying, F.col(id_col).cast("long").eqNullSafe(F.col(its_id)) & (F.col(own) == F.col(its_row)), "left_semi")
    return kept.dropDuplicates([id_col, own]).drop(own)


def digest(groups: DataFrame) -> DataFrame:
    """The contract's columns, from :func:`near_groups`."""
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
