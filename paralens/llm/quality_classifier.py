"""Naive Bayes support vectors: a linear hinge-loss model over n-grams scaled by class log-count ratios.

A text's features are the presence of hashed n-grams of its raw bytes and of n-grams over which
neighbouring words are equal. Each indicator is scaled by the log ratio of its smoothed counts in
the two classes (Wang and Manning 2012), texts are scaled to unit length, and the weights come from
dual coordinate descent (Hsieh et al. 2008). Margins become scores through a logistic curve fitted
on rows that the weights have not seen.

The model is fitted on at most MAX_TRAIN labelled rows, those of the smallest seeded hash; every row
is scored, over its whole text. However long the texts, the driver holds PART_FEATURES indicators at once:
the sample's rows are stored in parts of at most so many, which the descent visits one after another
(block minimisation, Yu et al. 2010), so no row is left out for its length.

Null texts are empty and get the score of the constant feature; without rows of both classes every score is the
share of label 1, or 0.5 without labels. Repeated rows are learnt from once and score alike, different texts of one
id are a row each; null labels are ignored; only id, text and label columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..store import Table
from .ragged import SPACED_WORD, Hashes, blocks, runs

DIMENSIONS = 1 << 18
BYTE_GRAM = 4
MAX_TRAIN = 8000
#: Indicators of training rows that are held at once; a row has at most DIMENSIONS.
PART_FEATURES = 15_000_000
#: Indicators that one job brings to the driver.
FETCHED = 1 << 19
SEED = 10_001
#: Text bytes whose indicators are held at once.
AT_ONCE = 1 << 19
#: Fits of the curve use every fifth training row.
FOLDS = 5


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature number of every indicator that is set, by row; feature 0 is constant."""
    n = len(offs) - 1
    keys = [np.arange(n, dtype=np.int64) * DIMENSIONS]
    size = len(data) - BYTE_GRAM + 1
    if size > 0:
        gram = np.zeros(size, np.uint32)
        for k in range(BYTE_GRAM):
            gram |= data[k : k + size].astype(np.uint32) << np.uint32(8 * k)
        slot = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(14)).astype(np.int64)
        row = np.repeat(np.arange(n), np.diff(offs))
        inside = row[:size] == row[BYTE_GRAM - 1 :]
        keys.append((row[:size] * DIMENSIONS + np.maximum(slot, 16))[inside])
    starts, ends, row = runs(SPACED_WORD[data], offs)
    h = Hashes(data).of(starts, ends)
    for k, gap in enumerate((1, 2)):  # words equal to the next, or to the one after it; and twice in a row
        if len(h) > gap:
            same = (h[gap:] == h[:-gap]) & (row[gap:] == row[:-gap])
            keys.append(row[:-gap][same] * DIMENSIONS + 1 + 2 * k)
            twice = same[gap:] & same[:-gap]
            keys.append(row[: len(twice)][twice] * DIMENSIONS + 2 + 2 * k)
    key = np.sort(np.concatenate(keys))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key >> 18, key & (DIMENSIONS - 1)


@dataclass
class Model:
    weights: np.ndarray  # of indicators, with their log-count ratios multiplied in
    squares: np.ndarray  # squared log-count ratios, for unit length
    slope: float
    shift: float
    constant: float | None = None

    def scores(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        row, feature = features(data, offs)
        length = np.sqrt(np.bincount(row, weights=self.squares[feature], minlength=n))
        margin = np.bincount(row, weights=self.weights[feature], minlength=n) / np.maximum(length, 1e-12)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


#: Feature numbers of each row of one part of the sample.
RowsOf = Callable[[int], list[np.ndarray]]


def log_ratios(parts: list[np.ndarray], rows_of: RowsOf, smooth: float = 1.0) -> np.ndarray:
    """Log ratio of each feature's smoothed counts; ``parts`` has labels of 1, -1, and 0 for rows not to count."""
    counts = [np.full(DIMENSIONS, smooth), np.full(DIMENSIONS, smooth)]
    for k, labels in enumerate(parts):
        for r, label in zip(rows_of(k), labels, strict=True):
            if label:
                counts[int(label < 0)][r] += 1  # each feature once a row
    ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    ratio[0] = 1.0
    return ratio


def block_descent(parts: list[np.ndarray], part_of: Callable[[int], tuple[list[np.ndarray], list[np.ndarray]]], cost: float = 1.0, epochs: int = 20, seed: int = SEED, tolerance: float = 0.01) -> np.ndarray:
    """Weights of the L1-loss, L2-regularised linear support vector machine, by dual coordinate descent over one part's rows after another's.

    ``parts`` has labels of 1, -1, and 0 for rows that take no part; ``part_of`` gives a part's feature numbers and values.
    """
    rng = np.random.default_rng(seed)
    alphas, w = [np.zeros(len(y)) for y in parts], np.zeros(DIMENSIONS)
    for _ in range(epochs):
        most, least = -np.inf, np.inf
        for k, (y, alpha) in enumerate(zip(parts, alphas, strict=True)):
            rows, values = part_of(k)
            for i in rng.permutation(np.flatnonzero(y)):
                gradient = y[i] * float(w[rows[i]] @ values[i]) - 1
                projected = min(gradient, 0.0) if alpha[i] == 0 else max(gradient, 0.0) if alpha[i] == cost else gradient
                most, least = max(most, projected), min(least, projected)
                diagonal = float(values[i] @ values[i])
                if abs(projected) > 1e-12 and diagonal > 0:
                    new = min(max(alpha[i] - gradient / diagonal, 0.0), cost)
                    w[rows[i]] += (new - alpha[i]) * y[i] * values[i]
                    alpha[i] = new
        if most - least < tolerance:
            break
    return w


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, **how: float) -> np.ndarray:
    """``block_descent`` over one part."""
    return block_descent([y], lambda k: (rows, values), **how)


def logistic_curve(margin: np.ndarray, positive: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and shift of the curve of largest likelihood, by damped Newton steps on smoothed targets (Platt 1999)."""
    n1, n0 = int(positive.sum()), int((~positive).sum())
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))])
    at = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])

    def loss(a: np.ndarray) -> float:
        z = a @ x
        return float(np.sum(np.logaddexp(0, z) - target * z))

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -500, 500)))
        gradient = x @ (p - target)
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-9 * np.eye(2), gradient)
        size = 1.0
        while size > 1e-8 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def fit_parts(labels: list[np.ndarray], rows_of: RowsOf) -> Model:
    """A model of labels of 0 and 1 a part, and the sorted feature numbers of a part's rows."""
    all_labels = np.concatenate([np.zeros(0, int), *labels])
    flat = np.zeros(0)
    if len(set(all_labels.tolist())) < 2:
        return Model(flat, flat, 0.0, 0.0, float(all_labels.mean()) if len(all_labels) else 0.5)
    y = np.where(all_labels == 1, 1, -1)
    aside = np.arange(len(y)) % FOLDS == 0
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside[:] = False
    used = np.split(np.where(aside, 0, y), np.cumsum([len(p) for p in labels])[:-1])
    ratio = log_ratios(used, rows_of)
    held: dict[int, tuple[list[np.ndarray], list[np.ndarray]]] = {}

    def part_of(k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The part's rows and their values at unit length; the last one asked for is kept."""
        if k not in held:
            held.clear()
            rows = rows_of(k)
            ends = np.cumsum([len(r) for r in rows])
            values = np.zeros(int(ends[-1]), np.float32)  # one array for all rows, so that its memory goes back at once
            unit = [values[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
            for r, v in zip(rows, unit, strict=True):
                v[:] = ratio[r]
                v /= max(float(np.sqrt(v @ v)), 1e-12)
            held[k] = rows, unit
        return held[k]

    w = block_descent(used, part_of)
    margin = np.array([float(w[r] @ v) for k in range(len(labels)) for r, v in zip(*part_of(k), strict=True)])
    seen = aside if aside.any() else ~aside
    slope, shift = logistic_curve(margin[seen], y[seen] == 1)
    return Model((w * ratio).astype(np.float64), ratio**2, slope, shift)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """A model of sorted feature numbers a row and labels of 0 and 1."""
    return fit_parts([np.asarray(labels, int)], lambda k: rows)


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, part_features: int = PART_FEATURES) -> Model:
    """A model of the rows of ``docs`` that ``labelled`` (id, label) names."""
    spark = docs.sparkSession
    label = labelled.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).cast("int").alias("__label"))
    sample = label.orderBy(F.xxhash64(F.lit(SEED), F.col("__id")), "__id").limit(max_train)
    chosen = docs.join(F.broadcast(sample), F.col(id_col) == F.col("__id")).select("__id", "__label", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text")).dropDuplicates(["__id", "__text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches, "__text", AT_ONCE):
            row, feature = features(data, offs)
            ends = np.cumsum(np.bincount(row, minlength=batch.num_rows))
            cells = [feature[a:b].astype(np.int32).tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.binary())], names=["__id", "__label", "features"])

    found = chosen.mapInArrow(run, T.StructType([*chosen.schema[:2], T.StructField("features", T.BinaryType())]))
    stored = Table(found.withColumn("digest", F.xxhash64("features")), "training-rows")
    one = stored.df.groupBy("__id", "digest").agg(F.min("__label").alias("label"), F.min(F.length("features") / 4).cast("long").alias("size"))
    rows = one.orderBy(F.xxhash64(F.lit(SEED), F.col("__id")), "__id", "digest").limit(max_train).collect()
    sizes = np.array([r["size"] for r in rows], np.int64)
    part = np.zeros(len(rows), np.int64)
    filled = 0
    for i, size in enumerate(sizes.tolist()):
        opens = filled > 0 and filled + size > part_features
        part[i:] += opens
        filled = size if opens else filled + size
    begin = [int(x) for x in np.flatnonzero(np.diff(part, prepend=-1))]
    parts = list(zip(begin, [*begin[1:], len(rows)], strict=False))  # none without rows
    # A row a training row, of which there are at most max_train.
    places = spark.createDataFrame([(r["__id"], r["digest"], i, int(part[i])) for i, r in enumerate(rows)], T.StructType([*one.schema[:2], T.StructField("place", T.LongType()), T.StructField("part", T.LongType())]))
    dealt = stored.df.join(F.broadcast(places), ["__id", "digest"]).select("part", "place", "features")
    placed = Table(dealt.repartitionByRange(max(1, len(parts)), "part").sortWithinPartitions("part", "place"), "training-parts", group_mb=16)
    stored.drop()

    def load(k: int) -> list[np.ndarray]:
        low, high = parts[k]
        ends = np.cumsum(sizes[low:high])
        values = np.zeros(int(ends[-1]), np.int32)
        out = [values[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        turn = (ends - sizes[low:high]) // FETCHED
        for t in np.unique(turn):
            at = np.flatnonzero(turn == t) + low
            for r in placed.df.where(F.col("place").between(int(at[0]), int(at[-1]))).select("place", "features").collect():
                out[r["place"] - low][:] = np.frombuffer(r["features"], np.int32)
        return out

    last: dict[int, list[np.ndarray]] = {}

    def rows_of(k: int) -> list[np.ndarray]:
        if k not in last:
            last.clear()
            last[k] = load(k)
        return last[k]

    model = fit_parts([np.array([r["label"] for r in rows[a:b]], int) for a, b in parts], rows_of)
    placed.drop()
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), keep_text: bool = False) -> DataFrame:
    """id, the columns named in ``carry``, the text if ``keep_text``, and ``score``."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # two arrays of DIMENSIONS numbers
    picked = docs.select(F.col(id_col), *(F.col(f"`{c}`") for c in carry), F.col(text_col).cast("string").alias("__text"))
    text = [T.StructField(text_col, T.StringType())] if keep_text else []
    schema = T.StructType([*picked.schema[:-1], *text, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in blocks(batches, "__text", AT_ONCE):
            yield pa.RecordBatch.from_arrays([*batch.columns[: None if keep_text else -1], pa.array(sent.value.scores(data, offs))], names=[f.name for f in schema])

    return picked.mapInArrow(run, schema)
