"""Quality classifier by co-training of two views.

The text view sees only the text: which words, word beginnings and punctuation runs
it holds and in which steps its layout figures lie (the most telling ones by
chi-square). The metadata view sees only the page's metadata: language, source and
length as the table tells them. Metadata is dealt to at most ``CELLS`` cells, so
this view is fitted on counts. For each target (low quality, toxic) both views are
fitted on labelled rows. In each round the text view scores every unlabelled
document and hands those it is sure of, by its calibrated probability, to the
metadata view, as counts by cell of all of them; the metadata view names the cells
it is sure of, and a bounded draw of their unlabelled documents goes to the text
view as labelled rows. At the end the views, calibrated on rows that neither was
fitted on, are combined (their log-odds less the prior's) and score every document.

Bounds: the fit of the text view uses at most ``n_labelled`` labelled documents,
those with the least seeded hash of the id, and ``n_pseudo`` pseudo-labelled ones
of each target and class, at any corpus size; of each class of a target ``RARE``
labelled rows come first, so that rare positives are kept, and the log-odds are
corrected by the classes' shares of all labelled documents (the models'
``shift``). Only the words of these rows and the counts of cells reach the
driver. Every document is scored, from its whole text, without a shuffle.

Defined results: null text counts as empty and is scored; a null source, language
or length is a value of its own; labels without id, or null in a target, are not
used; of repeated labels for one id the lowest quality and the highest toxicity
hold; repeated documents score alike, and of rows with one id the fit uses the one
with the least text; a target with fewer than ``MIN_CLASS``
examples of a class rejects nothing (probability 0); an empty table gives no rows.
Extra columns are carried along by :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowtext import texts
from .storage import unused, written

N_LABELLED = 9000
N_PSEUDO = 1000
#: How many labelled rows of each class of a target are kept before the others are drawn, or an eighth of the bound.
RARE = 300
ROUNDS = 2
FEATURES = 3000
SURE = 0.95
MIN_CLASS = 20
TARGETS = ("low", "toxic")
LANGS, SOURCES, LENGTHS = 32, 64, 32
CELLS = LANGS * SOURCES * LENGTHS
#: Punctuation that words are told without, and what begins the names of other features.
_QUIET = b".,;:!?\"'()\0\1\2\3"
_LETTERS = bytes(c for c in range(256) if c >= 0x80 or chr(c).isalnum())
_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
#: Upper ends of the steps of a share, and of the mean length of words and lines.
_SHARES = (0.0, 0.01, 0.03, 0.1, 0.25, 0.5, 0.75)
_LENGTHS = (2.0, 3.0, 4.0, 6.0, 9.0, 15.0, 40.0, 80.0, 200.0, 600.0)


def _seen(text: bytes) -> tuple[set[bytes], list[bytes]]:
    """The words of a text, and marks for its punctuation runs and layout steps."""
    words = text.lower().translate(None, _QUIET).split()
    distinct = set(words)
    marks = [b"\0" + p for p in set(text.translate(None, _LETTERS).split())]
    return distinct, marks + layout(text, words, len(distinct))


def _heads(words: set[bytes]) -> set[bytes]:
    """Features for the words' first four and five bytes."""
    return {b"\1" + w[:4] for w in words} | {b"\2" + w[:5] for w in words}


def features(text: bytes) -> set[bytes]:
    """All that the text view sees of a text."""
    words, marks = _seen(text)
    return words | _heads(words) | set(marks)


class Vocabulary(dict):
    """Numbers of features, given as they come."""

    def __missing__(self, feature: bytes) -> int:
        self[feature] = number = len(self)
        return number

    def row(self, found: set[bytes]) -> np.ndarray:
        return np.array(sorted(map(self.__getitem__, sorted(found))), np.int32)


def layout(text: bytes, words: list[bytes], distinct: int) -> list[bytes]:
    """A feature for each layout figure: the step it lies in."""
    size, n = max(1, len(text)), max(1, len(words))
    letters = max(1, size - len(text.translate(None, _LETTERS)))
    shares = (
        (size - len(text.translate(None, _UPPER))) / letters, (size - len(text.translate(None, _DIGITS))) / size, (size - letters - n) / size,
        min(1.0, distinct / n), sum(map(eq, words, words[1:])) / n,
    )
    lengths = ((size - n) / n, size / (1 + text.count(b"\n")))
    told = [b"\3s%d:%d" % (k, sum(x > e for e in _SHARES)) for k, x in enumerate(shares)]
    return told + [b"\3l%d:%d" % (k, sum(x > e for e in _LENGTHS)) for k, x in enumerate(lengths)]


def cell(documents: DataFrame, *, lang_col: str = "lang", source_col: str = "source", length_col: str = "n_chars") -> Column:
    """The metadata cell of a document: language and source hashed, the length in steps of a factor of two."""
    hashed = lambda c, n: F.pmod(F.crc32(F.coalesce(F.col(c), F.lit("\0")).cast("binary")), F.lit(n)).cast("int") if c in documents.columns else F.lit(0)
    steps = F.lit(0)
    if length_col in documents.columns:
        n = F.greatest(F.col(length_col).cast("double"), F.lit(0.0))
        steps = F.when(F.col(length_col).isNull(), 0).otherwise(F.least(1 + F.floor(F.log2(n + 1)), F.lit(LENGTHS - 1)))
    return ((hashed(lang_col, LANGS) * SOURCES + hashed(source_col, SOURCES)) * LENGTHS + steps).cast("int")


# --- the two views ------------------------------------------------------------------------------


@dataclass
class Sparse:
    """Rows of feature numbers, one after another."""

    index: np.ndarray
    sizes: np.ndarray

    @staticmethod
    def of(rows: list[np.ndarray]) -> Sparse:
        return Sparse(np.concatenate([np.zeros(0, np.int32), *rows]), np.array([r.size for r in rows], np.int64))

    def take(self, rows: np.ndarray) -> Sparse:
        ends = np.cumsum(self.sizes)
        return Sparse.of([self.index[ends[r] - self.sizes[r] : ends[r]] for r in rows])

    def plus(self, other: Sparse) -> Sparse:
        return Sparse(np.concatenate([self.index, other.index]), np.concatenate([self.sizes, other.sizes]))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(self.sizes.size, dtype=np.int32), self.sizes)
        return np.bincount(row, weights[self.index], self.sizes.size)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _descend(dim: int, score, back, y: np.ndarray, weight: np.ndarray, l2: float, steps: int) -> np.ndarray:
    """Weighted logistic regression by Adam over full passes; the last weight is the intercept."""
    w, m, v = np.zeros(dim + 1), np.zeros(dim + 1), np.zeros(dim + 1)
    weight = weight / weight.sum()
    w[-1] = _logit(weight @ y)
    for t in range(1, steps + 1):
        err = (_sigmoid(score(w[:-1]) + w[-1]) - y) * weight
        g = np.append(back(err) + l2 * w[:-1], err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


@dataclass
class TextView:
    """Weights by number, for rows of one vocabulary, and by feature."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    by_feature: dict[bytes, float] = field(default_factory=dict)

    def fit(self, x: Sparse, y: np.ndarray, names: Vocabulary) -> TextView:
        size, rows = len(names), y.size
        held = np.bincount(x.index, minlength=size)
        pos = np.bincount(x.index[np.repeat(y > 0.5, x.sizes)], minlength=size)
        want = held * y.mean()
        chi = (pos - want) ** 2 / np.maximum(want * (1 - y.mean()) * (1 - held / rows), 1e-9)
        chi[(held < 5) | (chi < 12)] = 0  # far beyond chance for one feature
        best = np.argsort(-chi, kind="stable")[:FEATURES]
        best = np.sort(best[chi[best] > 0])
        place = np.full(size, -1, np.int32)
        place[best] = np.arange(best.size, dtype=np.int32)
        kept = place[x.index]
        row = np.repeat(np.arange(rows, dtype=np.int32), x.sizes)[kept >= 0]
        kept = kept[kept >= 0]
        w = _descend(best.size, lambda w: np.bincount(row, w[kept], rows), lambda e: np.bincount(kept, e[row], best.size), y, np.ones(rows), 1e-4, 150)
        self.weights = np.zeros(size)
        self.weights[best] = w[:-1]
        self.bias = float(w[-1])
        named = list(names)
        self.by_feature = {named[n]: float(self.weights[n]) for n in best.tolist() if self.weights[n]}
        return self

    def logit(self, x: Sparse) -> np.ndarray:
        return x.dot(self.weights) + self.bias


def _places(cells: np.ndarray) -> np.ndarray:
    """The three indicator places of each cell."""
    return np.column_stack([cells // (SOURCES * LENGTHS), LANGS + cells // LENGTHS % SOURCES, LANGS + SOURCES + cells % LENGTHS])


@dataclass
class PageView:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(LANGS + SOURCES + LENGTHS))
    bias: float = 0.0

    def fit(self, counts: dict[int, np.ndarray]) -> PageView:
        """Of cells and how many documents of class 0 and 1 each holds."""
        cells = np.array(sorted(counts), np.int64)
        n = np.array([counts[c] for c in cells.tolist()], float)
        cells, n = cells[n.sum(axis=1) > 0], n[n.sum(axis=1) > 0]
        at, dim = _places(cells), self.weights.size
        back = lambda e: np.bincount(at.ravel(), np.repeat(e, 3), dim)
        w = _descend(dim, lambda w: w[at].sum(axis=1), back, n[:, 1] / n.sum(axis=1), n.sum(axis=1), 1e-3, 200)
        self.weights, self.bias = w[:-1], float(w[-1])
        return self

    def logit(self, cells: np.ndarray) -> np.ndarray:
        return self.weights[_places(np.asarray(cells, np.int64))].sum(axis=1) + self.bias


def calibrate(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope (not below 0) and intercept on held-out rows, with smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    goal = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([logits, np.ones(y.size)])
    w = np.array([0.0, _logit(goal.mean())])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - goal * z))

    for _ in range(100):  # Newton's method, halving steps that don't help
        p = _sigmoid(x @ w)
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-9 * np.eye(2), x.T @ (p - goal))
        size = 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (0.0, float(_logit(goal.mean())))


@dataclass
class Model:
    """Both calibrated views for one target."""

    text: TextView
    page: PageView
    text_scale: tuple[float, float]
    page_scale: tuple[float, float]
    prior: float
    base: float
    shift: float = 0.0

    def probability(self, text_logit: np.ndarray, cells: np.ndarray) -> np.ndarray:
        a = self.text_scale[0] * text_logit + self.text_scale[1]
        b = self.page_scale[0] * self.page.logit(cells) + self.page_scale[1]
        return _sigmoid(a + b - self.prior + self.shift)

    def sure(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a view's probability is surely that of class 0, and of class 1."""
        return p <= min(1 - SURE, 0.2 * self.base), p >= SURE

    def sure_by_text(self, text_logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.sure(_sigmoid(self.text_scale[0] * text_logit + self.text_scale[1]))

    def sure_cells(self) -> tuple[np.ndarray, np.ndarray]:
        zero, one = self.sure(_sigmoid(self.page_scale[0] * self.page.logit(np.arange(CELLS)) + self.page_scale[1]))
        return np.flatnonzero(zero), np.flatnonzero(one)


def co_train(names: Vocabulary, x: Sparse, cells: np.ndarray, ys: dict[str, np.ndarray], pool, rounds: int = ROUNDS, totals: dict[str, tuple[int, int]] | None = None) -> dict[str, Model | None]:
    """Fit both views of each target; ``ys`` are 1, 0 or NaN for a row without that label. Every third labelled row of a class is held out.

    ``pool`` stands for the unlabelled documents: ``counts(models)`` gives, for each target, how many of each class the
    text view is sure of by cell, ``draw(models)`` documents of the cells that the metadata view is sure of as
    (rows numbered by ``names``, classes). ``totals`` are the rows of class 0 and 1 that ``ys`` were drawn from, if those are more.
    """
    fits, models = {}, dict.fromkeys(ys)
    for t, y in ys.items():
        known = np.flatnonzero(~np.isnan(y))
        classes = [known[y[known] == c] for c in (0, 1)]
        if any(r.size < MIN_CLASS for r in classes):
            continue
        held = np.sort(np.concatenate([r[::3] for r in classes]))
        rows = np.setdiff1d(known, held)
        drawn = [r.size / n for r, n in zip(classes, totals[t] if totals else [r.size for r in classes])]
        by_cell: dict[int, np.ndarray] = {}
        for c, v in zip(cells[rows].tolist(), y[rows].astype(int).tolist()):
            by_cell.setdefault(c, np.zeros(2))[v] += 1
        fits[t] = rows, held, by_cell, float(np.log(drawn[0] / drawn[1])), float(y[known].mean())

    def made(t: str, more_text: tuple[Sparse, np.ndarray] | None, more_cells: dict[int, np.ndarray]) -> Model:
        rows, held, by_cell, shift, base = fits[t]
        y = ys[t]
        fx, fy = x.take(rows), y[rows]
        if more_text is not None:
            fx, fy = fx.plus(more_text[0]), np.concatenate([fy, more_text[1]])
        text = TextView().fit(fx, fy, names)
        page = PageView().fit({c: by_cell.get(c, 0) + np.asarray(more_cells.get(c, (0, 0)), float) for c in {*by_cell, *more_cells}})
        scales = calibrate(text.logit(x.take(held)), y[held]), calibrate(page.logit(cells[held]), y[held])
        return Model(text, page, *scales, float(_logit(base)), base, shift)

    models |= {t: made(t, None, {}) for t in fits}
    for _ in range(rounds if fits else 0):
        known = {t: models[t] for t in fits}
        counts, drawn = pool.counts(known), pool.draw(known)
        models |= {t: made(t, drawn.get(t), counts.get(t, {})) for t in fits}
    return models


class Scorer:
    """Text logits of documents for several models, by the features that any of them weighs."""

    def __init__(self, models: dict[str, Model | None]):
        self.models = {t: m for t, m in models.items() if m is not None}
        chosen = sorted({f for m in self.models.values() for f in m.text.by_feature})
        self.place = {f: k for k, f in enumerate(chosen)}
        # what a text is met with by its words, by their first four and five bytes
        self.words = frozenset(f for f in chosen if f[:1] not in (b"\0", b"\1", b"\2", b"\3"))
        self.four, self.five = ({f[1:]: k for f, k in self.place.items() if f[:1] == mark} for mark in (b"\1", b"\2"))
        self.heads = frozenset(self.four), frozenset(self.five)
        self.weights = {t: np.array([m.text.by_feature.get(f, 0.0) for f in chosen]) for t, m in self.models.items()}

    def row(self, text: bytes) -> list[int]:
        words, marks = _seen(text)
        five = {w[:5] for w in words}
        found = [self.place[w] for w in words & self.words] + [self.place[m] for m in marks if m in self.place]
        found += [self.five[h] for h in five & self.heads[1]]
        found += [self.four[h] for h in {h[:4] for h in five} & self.heads[0]]
        return sorted(found)  # so that sums don't depend on the order of sets

    def logits(self, batch: list[bytes]) -> dict[str, np.ndarray]:
        rows = Sparse.of([np.array(self.row(t), np.int32) for t in batch])
        return {t: rows.dot(self.weights[t]) + m.text.bias for t, m in self.models.items()}

    def probabilities(self, batch: list[bytes], cells: np.ndarray) -> dict[str, np.ndarray]:
        logits = self.logits(batch)
        return {t: self.models[t].probability(logits[t], cells) if t in self.models else np.zeros(len(batch)) for t in TARGETS}


# --- Spark ----------------------------------------------------------------------------------------


def labelled_ids(documents: DataFrame, labels: DataFrame, *, id_col: str) -> DataFrame:
    """(id, low, toxic) of every document with a label, written."""
    told = labels.select(F.col("doc_id").alias("_id"), (1 - F.col("quality")).cast("int").alias("low"), F.col("toxic").cast("int").alias("toxic"))
    told = told.filter("_id is not null").groupBy("_id").agg(F.max("low").alias("low"), F.max("toxic").alias("toxic"))
    return written(told.join(documents.select(F.col(id_col).alias("_id")), "_id", "left_semi"), "quality-labels")


def sample_ids(told: DataFrame, *, n_labelled: int, seed: int) -> DataFrame:
    """(id, low, toxic) of the labelled rows to fit on, at most n_labelled."""
    order = F.xxhash64(F.lit(seed), F.col("_id"))
    known = told.orderBy(order).limit(n_labelled).withColumn("rest", F.lit(1))
    for t in TARGETS:
        for c in (0, 1):  # rows of a frequent class are in the plain draw as well
            known = known.unionByName(told.filter(F.col(t) == c).orderBy(order).limit(min(RARE, n_labelled // 8)).withColumn("rest", F.lit(0)))
    return known.groupBy("_id", "low", "toxic").agg(F.min("rest").alias("rest")).orderBy("rest", order).limit(n_labelled).drop("rest")


def _told(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, text, cell)."""
    return documents.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"), cell(documents).alias("cell"))


def _tokens_of(docs: DataFrame, chosen: DataFrame) -> pa.Table:
    """(_id, x, cell) of the chosen ids (a bounded number), one row for each; x are the words and marks of the text."""
    # one row for each id, so that a repeated id can't exceed the bound
    rows = docs.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min(F.struct("text", "cell")).alias("r")).select("_id", "r.*")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [b"\n".join([*words, *marks]) for words, marks in map(_seen, texts(b.column(1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary()), b.column(2)], names=["_id", "x", "cell"])

    return rows.mapInArrow(tokens, "_id long, x binary, cell int").toArrow().sort_by("_id")


def _rows(names: Vocabulary, tokens: pa.ChunkedArray) -> Sparse:
    out = []
    for x in tokens.to_pylist():
        told = x.split(b"\n") if x else []
        out.append(names.row(_heads({w for w in told if w[:1] not in (b"\0", b"\3")}).union(told)))
    return Sparse.of(out)


class _Unlabelled:
    """The documents without a label, as :func:`co_train` asks for them."""

    def __init__(self, names: Vocabulary, docs: DataFrame, told: DataFrame, n_pseudo: int, seed: int):
        self.names, self.docs, self.told, self.n_pseudo, self.seed = names, docs, told.select("_id"), n_pseudo, seed

    def counts(self, models: dict[str, Model]) -> dict[str, dict[int, np.ndarray]]:
        sent = self.docs.sparkSession.sparkContext.broadcast(Scorer(models))

        def sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _parts(batches):
                logits = sent.value.logits(texts(b.column(1)))
                told = []
                for t in TARGETS:
                    zero, one = models_sure(sent.value, t, logits)
                    told.append(np.where(one, 1, np.where(zero, 0, -1)).astype(np.int32))
                any_ = pa.array((told[0] >= 0) | (told[1] >= 0))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *map(pa.array, told)], names=["_id", "cell", *TARGETS]).filter(any_)

        found = self.docs.mapInArrow(sure, "_id long, cell int, low int, toxic int").join(self.told, "_id", "left_anti")
        # at most CELLS rows
        rows = found.groupBy("cell").agg(*(F.count_if(F.col(t) == c).alias(f"{t}{c}") for t in TARGETS for c in (0, 1))).collect()
        sent.unpersist()
        return {t: {r.cell: np.array([r[f"{t}0"], r[f"{t}1"]], float) for r in rows} for t in models}

    def draw(self, models: dict[str, Model]) -> dict[str, tuple[Sparse, np.ndarray]]:
        rows = [(int(c), t, k) for t, m in models.items() for k, cells in enumerate(m.sure_cells()) for c in cells]
        if not rows:
            return {}
        # at most two rows for each cell and target
        cells = F.broadcast(self.docs.sparkSession.createDataFrame(rows, "cell int, target string, class int"))
        ids = self.docs.select("_id", "cell").filter("_id is not null").join(self.told, "_id", "left_anti").join(cells, "cell").select("_id", "target", "class").distinct()
        first = Window.partitionBy("target", "class").orderBy(F.xxhash64(F.lit(self.seed), F.col("_id")), "_id")
        ids = written(ids.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= self.n_pseudo).drop("n"), "quality-pseudo")
        got = _tokens_of(self.docs, ids.select("_id").distinct())
        place = {i: k for k, i in enumerate(got.column("_id").to_pylist())}
        x, out = _rows(self.names, got.column("x")), {}
        for t in models:
            told = sorted((r._id, r["class"]) for r in ids.filter(F.col("target") == t).collect())
            if told:
                out[t] = x.take(np.array([place[i] for i, _ in told])), np.array([c for _, c in told], float)
        return out


def models_sure(scorer: Scorer, target: str, logits: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where the text view is sure of class 0 and of class 1; nowhere without a model."""
    if target in scorer.models:
        return scorer.models[target].sure_by_text(logits[target])
    n = next(iter(logits.values())).size
    return np.zeros(n, bool), np.zeros(n, bool)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for at in range(0, big.num_rows, 500):
            yield big.slice(at, 500)


def fit(
    documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_labelled: int = N_LABELLED, n_pseudo: int = N_PSEUDO, rounds: int = ROUNDS, seed: int = 11
) -> dict[str, Model | None]:
    """A model for each target."""
    told = labelled_ids(documents, labels, id_col=id_col)
    counts = told.agg(*(F.count_if(F.col(t) == c).alias(f"{t}{c}") for t in TARGETS for c in (0, 1))).first()
    chosen = written(sample_ids(told, n_labelled=n_labelled, seed=seed), "quality-sample")
    docs = _told(documents, id_col, text_col)
    got = _tokens_of(docs, chosen.select("_id"))
    label = {r._id: r for r in chosen.collect()}
    of = lambda t: np.array([np.nan if label[i][t] is None else float(label[i][t]) for i in got.column("_id").to_pylist()])
    names, cells = Vocabulary(), got.column("cell").to_numpy().astype(np.int64)
    x, pool = _rows(names, got.column("x")), _Unlabelled(names, docs, told, n_pseudo, seed)
    return co_train(names, x, cells, {t: of(t) for t in TARGETS}, pool, rounds, {t: (counts[f"{t}0"], counts[f"{t}1"]) for t in TARGETS})


def score(documents: DataFrame, models: dict[str, Model | None], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, p_low, p_toxic, keep) of every row; a document stays if both are below one half."""
    sent = documents.sparkSession.sparkContext.broadcast(Scorer(models))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            p = sent.value.probabilities(texts(b.column(1)), b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p["low"]), pa.array(p["toxic"]), pa.array((p["low"] < 0.5) & (p["toxic"] < 0.5))], names=["doc_id", "p_low", "p_toxic", "keep"])

    return _told(documents, id_col, text_col).mapInArrow(scan, "doc_id long, p_low double, p_toxic double, keep boolean")


def keep_good(documents: DataFrame, models: dict[str, Model | None], *, text_col: str = "text") -> DataFrame:
    """The documents that stay, all their columns kept."""
    sent = documents.sparkSession.sparkContext.broadcast(Scorer(models))
    at = documents.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            last = b.num_columns - 1
            p = sent.value.probabilities(texts(b.column(at)), b.column(last).to_numpy())
            yield b.select(list(range(last))).filter(pa.array((p["low"] < 0.5) & (p["toxic"] < 0.5)))

    return documents.withColumn(unused(documents, "_fw_cell"), cell(documents)).mapInArrow(scan, documents.schema)
