"""Filing text: clean, split, index, retrieve."""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..plans.staging import staged

_TOKEN = r"[\p{L}\p{N}]+"
#: About how many queries of a vector search are broadcast at once.
QUERY_BLOCK = 10_000
#: About how many rows of a vector search make a task worth while, and how many meet the queries at once.
ROWS_PER_TASK, _ROWS = 8192, 2048
#: How many products of queries by rows a core holds at once, so that they stay in its cache.
_BLOCK = 524_288
#: How far a cosine is from the rounded one at most. What stands for no score.
_APART, _NONE = 5.1e-7, -1e300
#: About how many numbers of terms by queries are broadcast at once.
LEXICAL_BLOCK = 10_000_000
#: How many numbers of documents by terms and queries, or of queries by rows, are held at once.
_CELLS = 2_000_000


def html_text(html: Column) -> Column:
    """Text of a page: no scripts, styles, comments or tags, single spaces."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def chunk(documents: DataFrame, *, id_col: str, text_col: str, size: int = 512) -> DataFrame:
    """(id, chunk_no, chunk, ...): pieces of ``size`` characters, other columns kept as the chunk's metadata."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.ceil(F.length(text) / size).cast("int")
    rows = documents.filter(F.length(text) > 0).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("chunk", F.substring(F.col(text_col), F.col("chunk_no") * size + 1, F.lit(size))).drop(text_col).withColumnRenamed(id_col, "id")


def sentences(documents: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id, sentence_no, sentence), split after . ! or ?"""
    parts = F.filter(F.split(F.col(text_col), r"(?<=[.!?])\s+", -1), lambda s: F.trim(s) != "")
    return documents.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("sentence_no", "sentence"))


#: Headings of a filing's parts, as "Item 1A. Risk Factors".
_HEADING = r"(?i)\bitem\s+([0-9]{1,2}[a-c]?)\s*[.:]"


def sections(documents: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id, n_sections, sections): the items that a text has headings for, in order."""
    found = F.transform(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(_HEADING), F.lit(1)), F.upper)
    return documents.select(F.col(id_col).alias("id"), F.array_distinct(found).alias("sections")).select("id", F.size("sections").alias("n_sections"), "sections")


def sentence_chunks(documents: DataFrame, *, id_col: str, text_col: str, size: int = 512) -> DataFrame:
    """(id, chunk_no, chunk, n_sentences, section, ...): sentences gathered to pieces; other columns kept as metadata.

    A sentence belongs to the piece in which it begins, if all were strung together and cut each ``size`` characters; so
    no sentence is cut, and a long one is a piece of its own. ``section`` is the last heading up to the piece's end. An
    id names one row.
    """
    rest = [c for c in documents.columns if c not in (id_col, text_col)]
    parts = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?<=[.!?])\s+", -1), lambda s: F.trim(s) != "")
    rows = documents.select(F.col(id_col).alias("id"), *rest, F.posexplode(parts).alias("n", "sentence"))
    before = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.nullif(F.upper(F.regexp_extract("sentence", _HEADING, 1)), F.lit(""))
    rows = rows.withColumn("_at", F.coalesce(F.sum(F.length("sentence") + 1).over(before), F.lit(0))).withColumn("section", F.last(heading, ignorenulls=True).over(upto))
    rows = rows.withColumn("_piece", F.floor(F.col("_at") / size))
    told = rows.groupBy("id", *rest, "_piece").agg(F.array_sort(F.collect_list(F.struct("n", "sentence"))).alias("s"), F.max_by("section", "n").alias("section"))
    numbered = told.withColumn("chunk_no", F.row_number().over(Window.partitionBy("id").orderBy("_piece")) - 1)
    return numbered.select("id", "chunk_no", F.array_join(F.col("s.sentence"), " ").alias("chunk"), F.size("s").alias("n_sentences"), "section", *rest)


def filing_chunks(texts: DataFrame, filings: DataFrame, companies: DataFrame, *, size: int = 512) -> DataFrame:
    """Pieces of filing texts (accession_number, text) with ticker, CIK, form, filing date, section, accession and source."""
    told = texts.join(filings.select("accession_number", "cik", "form_type", "filing_date", "source"), "accession_number", "left")
    told = told.join(companies.select("cik", "ticker"), "cik", "left").withColumn("id", F.col("accession_number"))
    return sentence_chunks(told, id_col="id", text_col="text", size=size)


def missing_metadata(chunks: DataFrame, columns: list[str]) -> DataFrame:
    """(id, chunk_no, missing): pieces that lack some of the columns."""
    absent = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)))
    return chunks.select("id", "chunk_no", absent.alias("missing")).filter(F.size("missing") > 0)


def chunk_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("chunk")).alias("n_chars"), F.max(F.length("chunk")).cast("long").alias("longest"))


def _terms(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    terms = F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(_TOKEN), F.lit(0)))
    return documents.select(F.col(id_col).alias("id"), terms.alias("term"))


def term_counts(documents: DataFrame, *, id_col: str, text_col: str, wanted: DataFrame | None = None) -> DataFrame:
    """(id, term, tf), of the ``wanted`` terms if they are given; others are dropped before they are counted."""
    terms = _terms(documents, id_col, text_col)
    if wanted is not None:
        terms = terms.join(wanted.select("term").distinct(), "term", "left_semi")
    return terms.groupBy("id", "term").agg(F.count("*").alias("tf"))


def lexical_topk(documents: DataFrame, queries: DataFrame, *, id_col: str, text_col: str, query_id: str, query_text: str, k: int = 5) -> DataFrame:
    """(query_id, rank, id, score): tf-idf over the terms that the queries hold; ties to the smaller id.

    Only postings of query terms are kept, worked out once and staged. Documents meet the queries in blocks of about
    ``LEXICAL_BLOCK`` terms by queries, by one matrix product for each batch; a task hands on its best ``k``.
    """
    spark = documents.sparkSession
    asked = staged(term_counts(queries, id_col=query_id, text_col=query_text).select(F.col("id").alias("query_id"), "term", F.col("tf").alias("qtf")), "asked")
    postings = staged(term_counts(documents, id_col=id_col, text_col=text_col, wanted=asked), "postings")
    n = documents.count()
    spread = postings.groupBy("term").agg(F.count("*").alias("df")).select("term", F.log(F.lit(1.0) + F.lit(n) / F.col("df")).alias("idf"))
    weight = ((1 + F.log("tf")) * F.col("idf")).alias("weight")
    told = postings.join(spread, "term").groupBy("id").agg(F.collect_list(F.struct("term", weight)).alias("terms"))
    n_terms, n_queries = asked.agg(F.count("*"), F.count_distinct("query_id")).first()
    blocks = max(1, math.ceil(math.sqrt(n_terms * n_queries / LEXICAL_BLOCK)))  # a block has fewer terms and fewer queries
    if blocks > 1:
        told = staged(told, "weighted")
    schema = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField("id", told.schema["id"].dataType), StructField("score", DoubleType())])
    found = None
    for n in range(blocks):
        mine = asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)
        sent = spark.sparkContext.broadcast(_term_matrix(mine.toArrow()))
        one = told.mapInArrow(_best_by_terms(sent, k), schema)
        found = one if found is None else found.unionByName(one)
    return _top(found, k)


def _term_matrix(asked: pa.Table) -> tuple[pa.Array, dict[str, int], np.ndarray]:
    """(query ids, the row of each term, the weights of terms in queries)."""
    ids = pc.unique(asked.column("query_id"))
    terms = {t: n for n, t in enumerate(pc.unique(asked.column("term")).to_pylist())}
    m = np.zeros((len(terms), len(ids)))
    m[[terms[t] for t in asked.column("term").to_pylist()], pc.index_in(asked.column("query_id"), ids).to_numpy()] = asked.column("qtf").to_numpy()
    return ids, terms, m


def _best_by_terms(sent, k: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, terms, m = sent.value
        rows = max(1, _CELLS // max(1, len(terms) + len(queries)))
        # a row for each query: what is best so far
        held = [[] for _ in range(len(queries))]
        kind = None
        for big in batches:
            kind = big.schema.field(0).type
            for at in range(0, big.num_rows, rows):
                b = big.slice(at, rows)
                told = b.column(1)
                flat = told.flatten()
                place = np.array([terms.get(t, -1) for t in flat.field("term").to_pylist()], np.int64)
                row = np.repeat(np.arange(b.num_rows), pc.list_value_length(told).to_numpy(zero_copy_only=False).astype(np.int64))
                x = np.zeros((b.num_rows, len(terms)))
                x[row[place >= 0], place[place >= 0]] = flat.field("weight").to_numpy(zero_copy_only=False)[place >= 0]
                scores, ids = np.round(x @ m, 6), b.column(0).to_pylist()
                for q in range(len(queries)):
                    s = scores[:, q]
                    least = max(held[q][-1][0] * -1 if len(held[q]) == k else 0.0, np.partition(s, -k)[-k] if s.size > k else 0.0)
                    new = [(-s[i], ids[i] is not None, ids[i]) for i in np.flatnonzero((s >= least) & (s > 0)).tolist()]
                    if new:
                        held[q] = sorted(held[q] + new)[:k]
        if kind is not None:
            flat = [(q, s, i) for q, h in enumerate(held) for s, _, i in h]
            yield pa.RecordBatch.from_arrays(
                [queries.take(pa.array([q for q, _, _ in flat], pa.int64())), pa.array([i for _, _, i in flat], kind), pa.array([-float(s) for _, s, _ in flat], pa.float64())], names=["query_id", "id", "score"]
            )

    return best


def vector_topk(rows: DataFrame, queries: DataFrame, *, id_col: str, vector_col: str, k: int = 5) -> DataFrame:
    """(query_id, rank, id, score): cosine, ties to the smaller id; any number of queries, broadcast in blocks.

    A query's rows are all in the block that its id's hash names, so each block is a search of its own. Rows are dealt
    evenly and meet a block by matrix products of single precision; what these leave in reach of the best is scored term
    by term, and a task hands on its best ``k``. Vectors of unlike lengths, null, with a null or of norm zero have no
    score and come last.
    """
    spark = rows.sparkSession
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parts, cores = max(1, -(-rows.count() // ROWS_PER_TASK)), spark.sparkContext.defaultParallelism
    if parts > cores:
        parts = cores * min(4, -(-parts // cores))  # no core waits for the others' last tasks
    rows, queries = (x.select(F.col(id_col).alias("id"), _numbers(x, vector_col).alias("v")).filter("id is not null") for x in (rows, queries))
    rows = rows.repartition(parts)
    if blocks > 1:
        rows = staged(rows, "vectors")
    schema = StructType([StructField("query_id", queries.schema["id"].dataType), StructField("id", rows.schema["id"].dataType), StructField("score", DoubleType())])
    found = []
    for b in range(blocks):
        mine = queries if blocks == 1 else queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        sent = spark.sparkContext.broadcast(_by_length(mine.toArrow()))
        found.append(rows.mapInArrow(_best_by_cosine(sent, k), schema))
    return _top(reduce(DataFrame.unionByName, found), k)


def _numbers(df: DataFrame, name: str) -> Column:
    """Vectors of doubles, or of floats where they are so: half the bytes to send."""
    return F.col(name) if df.select(name).schema[0].dataType.simpleString() == "array<float>" else F.col(name).cast("array<double>")


def _vectors(v: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(each vector's length, 0 if it is null or holds a null; each number's vector; the numbers)."""
    sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, row = v.flatten(), np.repeat(np.arange(sizes.size), sizes)
    sizes[row[flat.is_null().to_numpy(zero_copy_only=False)]] = 0
    return sizes, row, flat.to_numpy(zero_copy_only=False).astype(np.float64)


def _by_length(asked: pa.Table) -> list[tuple[pa.Array, np.ndarray]]:
    """(query ids, their vectors) for each length."""
    ids, v = asked.column(0).combine_chunks(), asked.column(1).combine_chunks()
    sizes, row, x = _vectors(v)
    return [(ids.take(pa.array(np.flatnonzero(sizes == n))), x[sizes[row] == n].reshape(-1, n) if n else np.zeros(((sizes == 0).sum(), 0))) for n in np.unique(sizes).tolist()]


def _comparable(ids: pa.Array) -> np.ndarray:
    if pa.types.is_integer(ids.type):
        return ids.to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.empty(len(ids), object)
    out[:] = ids.to_pylist()
    return out


def _best_by_cosine(sent, k: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kind = [_Nearest(ids, m, k, _CELLS) for ids, m in sent.value], None
        with np.errstate(all="ignore"):
            for big in batches:
                kind = big.schema.field(0).type
                for at in range(0, big.num_rows, _ROWS):
                    b = big.slice(at, _ROWS)
                    names = _comparable(b.column(0))
                    order = np.argsort(names, kind="stable")
                    sizes, row, x = _vectors(b.column(1).take(pa.array(order)))
                    for h in held:
                        own = np.flatnonzero(sizes == h.vectors.shape[1])
                        h.add(names[order], own, x[sizes[row] == h.vectors.shape[1]].reshape(own.size, -1) if own.size and h.vectors.shape[1] else np.zeros((own.size, h.vectors.shape[1])))
        if kind is not None:
            yield from (h.rows(kind) for h in held)

    return best


class _Nearest:
    """The best ``k`` rows so far of queries whose vectors have one length. Scores order as Spark's: NaN is inf here, none ``_NONE``."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, k: int, cells: int):
        self.ids, self.names, self.vectors, self.k, self.cells = ids, _comparable(ids), vectors, k, cells
        with np.errstate(all="ignore"):
            self.norms, fine, units = _units(vectors)
        self.fine, self.zero, self.odd = (np.flatnonzero(x) for x in (fine, self.norms == 0, ~fine & (self.norms != 0)))
        self.units = units[fine].astype(np.float32)
        # a sum of d products of single precision is off by (d + 2) / 2^24 at most, but for terms of higher order
        self.apart = _APART + 1.1 * (vectors.shape[1] + 8) / 2**24
        self.scores, self.found = np.full((len(ids), k), -np.inf), None

    def add(self, names: np.ndarray, own: np.ndarray, v: np.ndarray) -> None:
        """Rows in the order of their ids; those at ``own`` have vectors ``v`` of this length."""
        if self.found is None:
            self.found = np.zeros(self.scores.shape, names.dtype)
        kind = np.unique(v.view(f"V{8 * v.shape[1]}").ravel(), return_inverse=True)[1] if v.size else np.zeros(len(v), int)
        few = _first_copies(names[own], kind, self.k)
        stay = np.ones(names.size, bool)
        stay[np.delete(own, few)] = False
        names, own, v = names[stay], (np.cumsum(stay) - 1)[own[few]], v[few]
        norms, fine, units = _units(v)
        if fine.any():
            self._add_fine(names[own[fine]], v[fine], norms[fine], units[fine].astype(np.float32).T)
        other = np.ones(names.size, bool)
        other[own[fine]] = False
        some = ~fine & (norms != 0)
        self._add_plain(self.fine, names[other], (np.cumsum(other) - 1)[own[some]], v[some], norms[some])
        some = ~np.isfinite(norms)
        self._add_plain(self.zero, names, own[some], v[some], norms[some])
        self._add_plain(self.odd, names, own, v, norms)

    def _add_fine(self, names: np.ndarray, v: np.ndarray, norms: np.ndarray, units: np.ndarray) -> None:
        """Rows and queries whose norms are fit to divide by."""
        low, high, last = (*self._places(names, self.fine), names.size - self.k)
        step = max(1, min(_BLOCK, self.cells) // names.size)
        for at in range(0, self.fine.size, step):
            mine, near = self.fine[at : at + step], self.units[at : at + step] @ units
            for i in np.flatnonzero(low[at : at + step] < high[at : at + step]).tolist():
                near[i, low[at + i] : high[at + i]] = -np.inf  # the query itself
            cut = self.scores[mine, -1] - self.apart
            if last > 0 and np.isneginf(cut).any():
                cut = np.maximum(cut, np.partition(near, last, axis=1)[:, last].astype(np.float64) - 2 * self.apart)
            hit = np.flatnonzero(near >= np.nextafter(cut.astype(np.float32), np.float32(-np.inf))[:, None])
            i, j = np.divmod(hit[near.ravel()[hit] > -np.inf], names.size)
            self._keep(mine[i], self._cosines(v, norms, mine[i], j), names[j])

    def _add_plain(self, asked: np.ndarray, names: np.ndarray, own: np.ndarray, v: np.ndarray, norms: np.ndarray) -> None:
        """Every pair of the rows at ``own`` is scored term by term; the others have no score with these queries."""
        if not names.size or not own.size and (self.scores[asked, -1] > _NONE).all():
            return
        kind = np.zeros(names.size, int)
        kind[own] = np.arange(1, own.size + 1)
        few = _first_copies(names, kind, self.k)
        names, own = names[few], np.searchsorted(few, own)
        low, high, last = (*self._places(names, asked), names.size - self.k)
        step = max(1, self.cells // names.size)
        for at in range(0, asked.size, step):
            mine = asked[at : at + step]
            near = np.full((mine.size, names.size), _NONE)
            near[:, own] = self._cosines(v, norms, np.repeat(mine, own.size), np.tile(np.arange(own.size), mine.size)).reshape(mine.size, own.size)
            for i in np.flatnonzero(low[at : at + step] < high[at : at + step]).tolist():
                near[i, low[at + i] : high[at + i]] = -np.inf  # the query itself
            cut = self.scores[mine, -1]
            if last > 0 and np.isneginf(cut).any():
                cut = np.maximum(cut, np.partition(near, last, axis=1)[:, last])
            i, j = np.nonzero((near >= cut[:, None]) & (near > -np.inf))
            self._keep(mine[i], near[i, j], names[j])

    def _places(self, names: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows with a query's own id begin and end."""
        return np.searchsorted(names, self.names[asked], "left"), np.searchsorted(names, self.names[asked], "right")

    def _keep(self, i: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        """Scores of queries i with the rows so named, if they are among the best."""
        new = score >= self.scores[i, -1]
        i, score, name = i[new], score[new], name[new]
        old = np.unique(i)
        i, score, name = np.append(np.repeat(old, self.k), i), np.append(self.scores[old], score), np.append(self.found[old], name)
        there = score > -np.inf
        i, score, name = i[there], score[there], name[there]
        order = np.lexsort((name, -score, i))
        i, score, name = i[order], score[order], name[order]
        rank = np.arange(i.size) - np.searchsorted(i, i)
        top = rank < self.k
        self.scores[i[top], rank[top]], self.found[i[top], rank[top]] = score[top], name[top]

    def _cosines(self, v: np.ndarray, norms: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Rounded cosines of queries i and rows j, summed in the order of the components."""
        out, length = np.full(i.size, _NONE), self.vectors.shape[1]
        step = max(1, self.cells // max(1, length))
        for at in range(0, i.size if length else 0, step):
            a, b = i[at : at + step], j[at : at + step]
            under = self.norms[a] * norms[b]
            score = np.cumsum(self.vectors[a] * v[b], axis=1)[:, -1] / under
            out[at : at + step] = np.where(under == 0, _NONE, np.where(np.isnan(score), np.inf, _rounded(score)))
        return out

    def rows(self, kind: pa.DataType) -> pa.RecordBatch:
        i, j = np.nonzero(self.scores > -np.inf)
        score = self.scores[i, j]
        told = pa.array(np.where(np.isinf(score), np.nan, score), mask=score == _NONE)
        return pa.RecordBatch.from_arrays([self.ids.take(pa.array(i)), pa.array(self.found[i, j].tolist(), kind), told], names=["query_id", "id", "score"])


def _first_copies(names: np.ndarray, kind: np.ndarray, k: int) -> np.ndarray:
    """Where rows stand, in the order of their ids, without those of a kind that ``k`` of it go before in any search."""
    if not names.size:
        return np.zeros(0, int)
    order = np.argsort(kind, kind="stable")
    rank = np.arange(kind.size) - np.searchsorted(kind[order], kind[order])
    own = np.unique(names, return_counts=True)[1].max()  # rows that a query leaves out as its own
    return np.sort(order[rank < k + own])


def _units(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(norms, whether they are fit to divide by, vectors divided by them)."""
    norms = np.sqrt(np.cumsum(m * m, axis=1)[:, -1]) if m.shape[1] else np.zeros(len(m))
    fine = (norms > 1e-100) & (norms < 1e100)
    return norms, fine, np.where(fine[:, None], m, 0.0) / np.where(fine, norms, 1.0)[:, None]


def _rounded(x: np.ndarray) -> np.ndarray:
    """To six places as Spark does: halves of the shortest decimal form go away from zero."""
    y = np.abs(x) * 1e6
    out = np.copysign(np.floor(y + 0.5) / 1e6, x)
    for i in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-4).tolist():
        out[i] = Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP)
    return out + 0.0  # no negative zeros


def _top(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def flag_weak(found: DataFrame, queries: DataFrame, *, query_id: str, minimum: float) -> DataFrame:
    """(query_id, n_results, best, is_weak) of every query, also of those that found nothing."""
    best = found.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))
    rows = queries.select(F.col(query_id).alias("query_id")).distinct().join(best, "query_id", "left")
    return rows.select("query_id", F.coalesce("n", F.lit(0)).alias("n_results"), "best", (F.coalesce("best", F.lit(float("-inf"))) < minimum).alias("is_weak"))
