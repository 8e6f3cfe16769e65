"""Quality by kernel ridge regression on document statistics.

A text becomes `len(STATISTICS)` numbers. Scaled by their means and deviations over the
training rows they pass through random Fourier features, which stand for a Gaussian kernel.
Each partition sums its part of the normal equations, for each fold of rows apart; the sums
are added up by Spark and the driver solves a system of `FEATURES` unknowns. Fitting without
a fold gives scores of rows that the fit has not seen; an isotonic regression on a histogram
of those scores turns a score into the share of good texts.

Statistics are counted over whole texts. A null text counts as empty. Words are runs of
anything but white space. Rows that repeat an id are scored one by one. Without labelled rows
every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankweave.llm.words import LOWER, SOLID, blocks, per_text, span_hashes, word_bounds
from rankweave.session import written

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "bar", "exclaim", "stop", "comma", "blank",
    "break", "high", "distinct", "echo", "line_repeats", "log_line", "capital_words", "symbol_words", "pair_repeats")
FEATURES = 192
WIDTH = 6.0
RIDGE = 1e-3
FOLDS = 4
BINS = 512

_B = np.arange(256)


def _one_of(chars: str) -> np.ndarray:
    return np.isin(_B, list(chars.encode()))


_UPPER, _DIGIT, _LETTER = (_B >= 65) & (_B <= 90), (_B >= 48) & (_B <= 57), (_B >= 97) & (_B <= 122)
_SYMBOL = _one_of("#$%&*+/<=>@[\\]^_`{}~")
_TABLES = (_UPPER, _DIGIT, _SYMBOL, _one_of("|"), _one_of("!?"), _one_of(".;:"), _one_of(","), ~SOLID, _one_of("\n"),
           _B >= 128)


def _distinct(keys: np.ndarray, of: np.ndarray, texts: int) -> np.ndarray:
    """Different keys of each text."""
    if not len(keys):
        return np.zeros(texts)
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    return np.bincount(of[new], minlength=texts).astype(float)


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of `STATISTICS` for each text."""
    texts = len(at) - 1
    size = np.diff(at).astype(float)
    some = np.maximum(size, 1)
    counts = [per_text(table[data], at) / some for table in _TABLES]
    starts, ends, first = word_bounds(data, at, SOLID)
    words = np.diff(first).astype(float)
    n = np.maximum(words, 1)
    hashes = span_hashes(LOWER[data], starts, ends)
    of = np.repeat(np.arange(texts), np.diff(first))
    same = np.zeros(len(hashes))
    pair = np.zeros(len(hashes), np.uint64)
    if len(hashes):
        mine = of[1:] == of[:-1]
        same[1:] = (hashes[1:] == hashes[:-1]) & mine
        pair[1:] = hashes[1:] * np.uint64(3) + hashes[:-1]
    breaks = np.flatnonzero(data == 10)
    line_start = np.union1d(at[:-1][size > 0], breaks + 1)
    line_start = line_start[line_start < len(data)]
    line_end = np.append(line_start[1:], len(data))
    line_of = np.searchsorted(at, line_start, side="right") - 1
    lines = np.bincount(line_of, minlength=texts).astype(float) if len(line_start) else np.zeros(texts)
    line_keys = span_hashes(data, line_start, line_end - (data[line_end - 1] == 10)) if len(line_start) else hashes[:0]
    head = data[starts] if len(starts) else data[:0]
    tail = data[ends - 1] if len(starts) else data[:0]
    columns = [
        np.log1p(size), np.log1p(words), np.minimum(per_text(ends - starts, first) / n, 40),
        *counts,
        _distinct(hashes, of, texts) / n, per_text(same, first) / n,
        1 - _distinct(line_keys, line_of, texts) / np.maximum(lines, 1), np.log1p(size / np.maximum(lines, 1)),
        per_text(_UPPER[head], first) / n, per_text(_SYMBOL[tail], first) / n,
        1 - _distinct(pair, of, texts) / n,
    ]
    return np.stack(columns, axis=1)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [statistics(data, at) for _, _, data, at in blocks(batch.column(1))]
        rows = np.concatenate(found) if found else np.zeros((0, len(STATISTICS)))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(STATISTICS))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists.cast(pa.list_(pa.float64()))], names=["id", "facts"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, facts): the statistics of every row of `docs`."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["id"], T.StructField("facts", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(_measured, schema)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    turns: np.ndarray = field(init=False)
    shift: np.ndarray = field(init=False)
    weights: np.ndarray | None = None
    edges: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))
    levels: np.ndarray = field(default_factory=lambda: np.array([0.5, 0.5]))

    def __post_init__(self) -> None:
        draw = np.random.default_rng(42)
        self.turns = draw.normal(size=(len(STATISTICS), FEATURES - 1)) / WIDTH
        self.shift = draw.uniform(0, 2 * np.pi, FEATURES - 1)

    def features(self, facts: np.ndarray) -> np.ndarray:
        x = np.clip((facts - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2 / (FEATURES - 1)) * np.cos(x @ self.turns + self.shift)
        return np.column_stack([waves, np.ones(len(x))])

    def score(self, facts: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(facts), 0.5)
        return np.clip(np.interp(self.features(facts) @ self.weights, self.edges, self.levels), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def _normal_sums(batches: Iterator[pa.RecordBatch], model: QualityModel) -> Iterator[pa.RecordBatch]:
    """(fold, row, values): this partition's part of X'X with X'y as its last column."""
    sums = np.zeros((FOLDS, FEATURES, FEATURES + 1))
    for batch in batches:
        x, y = model.features(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
        part = batch.column(2).to_numpy(zero_copy_only=False)
        for k in range(FOLDS):
            mine = part == k
            sums[k] += x[mine].T @ np.column_stack([x[mine], y[mine]])
    lists = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), FEATURES + 1).cast(pa.list_(pa.float64()))
    fold, row = np.divmod(np.arange(FOLDS * FEATURES), FEATURES)
    if sums.any():
        yield pa.RecordBatch.from_arrays([pa.array(fold.astype(np.int32)), pa.array(row.astype(np.int32)), lists],
                                         names=["fold", "row", "values"])


def _binned(batches: Iterator[pa.RecordBatch], model: QualityModel, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(bin, n, good): a histogram of scores by the weights that leave a row's own fold out."""
    n, good = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for batch in batches:
        x, y = model.features(_matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False)
        part = batch.column(2).to_numpy(zero_copy_only=False)
        place = _bin((x * weights[part]).sum(axis=1))
        n += np.bincount(place, minlength=BINS)
        good += np.bincount(place, y, BINS).astype(np.int64)
    full = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(n[full]), pa.array(good[full])],
                                     names=["bin", "n", "good"])


def _bin(score: np.ndarray) -> np.ndarray:
    """Bins of equal width over -0.5 to 1.5."""
    return np.clip(((score + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest never-falling sequence, by pooling neighbours that fall."""
    pools: list[list[float]] = []
    for value, weight in zip(values.tolist(), weights.tolist(), strict=True):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, w, k = pools.pop()
            u, x, j = pools[-1]
            pools[-1] = [(u * x + v * w) / (x + w), x + w, j + k]
    return np.concatenate([np.full(int(k), v) for v, _, k in pools]) if pools else np.zeros(0)


def fit(facts: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """Fit on `labels` (id, 0 or 1; of repeated ids the larger label) and all statistics of `measured`."""
    truth = (labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id"))
             .agg(F.max(label_col).cast("int").alias("good")))
    fold = F.pmod(F.xxhash64("id", F.lit(13)), F.lit(FOLDS)).cast("int").alias("fold")
    rows = written(facts.join(truth, "id").select("facts", "good", fold), "labelled")
    moments = rows.agg(*(f(F.get("facts", F.lit(k))) for k in range(len(STATISTICS))
                         for f in (F.avg, F.stddev_pop))).first()
    if moments[0] is None:
        return QualityModel(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    model = QualityModel(np.array(moments[::2]), np.maximum(np.array(moments[1::2]), 1e-6))
    sent = rows.sparkSession.sparkContext.broadcast(model)
    parts = rows.mapInArrow(lambda b: _normal_sums(b, sent.value), "fold int, row int, values array<double>")
    summed = parts.groupBy("fold", "row").agg(
        F.array(*(F.sum(F.get("values", F.lit(k))) for k in range(FEATURES + 1))).alias("values"))
    sums = np.zeros((FOLDS, FEATURES, FEATURES + 1))
    for r in summed.collect():                           # FOLDS * FEATURES rows
        sums[r["fold"], r["row"]] = r["values"]
    whole = sums.sum(axis=0)

    def solve(total: np.ndarray) -> np.ndarray:
        return np.linalg.solve(total[:, :-1] + RIDGE * max(total[-1, -2], 1) * np.eye(FEATURES) / FEATURES, total[:, -1])

    without = np.stack([solve(whole - sums[k]) for k in range(FOLDS)])
    bins = rows.mapInArrow(lambda b: _binned(b, sent.value, without), "bin int, n long, good long")
    bins = sorted(bins.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).collect())
    n, good = np.array([r["n"] for r in bins], float), np.array([r["good"] for r in bins], float)
    model.weights = solve(whole)
    model.edges = (np.array([r["bin"] for r in bins]) + 0.5) / BINS * 2 - 0.5
    model.levels = isotonic(good / n, n)
    return model


def _scores(batches: Iterator[pa.RecordBatch], model: QualityModel) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))],
                                         names=["id", "score"])


def scored(facts: DataFrame, model: QualityModel) -> DataFrame:
    """(id, score) of every row of `measured`, 0 to 1, higher for better text."""
    sent = facts.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([facts.schema["id"], T.StructField("score", T.DoubleType())])
    return facts.mapInArrow(lambda b: _scores(b, sent.value), schema)
