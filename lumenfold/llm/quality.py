"""Quality scores by regularised quadratic discriminant analysis.

Each text becomes a vector of transformed statistics (log lengths and logs of
smoothed ratios). Per class, count, sum and sum of products give mean and
covariance, which is shrunk towards the diagonal of the pooled one. The score is
the logistic function of the difference of log prior plus log density, with
Mahalanobis distances from the Cholesky factors kept in the model.

Moments cover every labelled training row and add up in partial aggregates;
one row per class reaches the driver. Null and empty texts have the statistics
of no characters. Repeated label rows of a document count as their mean (0.5
and over is class 1); labels without a value or a document are left out. With
one class the score is that class, with none 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import map_texts

#: Share of the pooled diagonal in each class covariance.
SHRINKAGE = 0.05
THRESHOLD = 0.3

STATISTICS = (
    "chars", "words", "word_length", "upper", "digits", "stops", "bars", "bangs", "symbols", "other_marks",
    "not_ascii", "distinct_words", "distinct_lines", "line_length", "entropy", "capitals",
)

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_GROUPS = {"stops": b".,;:", "bars": b"|", "bangs": b"!?", "symbols": b"#$%&*@~^=+<>{}[]\\"}
_MARKS = {k: np.isin(_BYTES, list(v)) for k, v in _GROUPS.items()}
_SPACE = np.isin(_BYTES, list(b" \t\n\r\x0b\x0c"))
_OTHER = (_BYTES > 32) & (_BYTES < 127) & ~(_UPPER | _LOWER | _DIGIT) & ~np.any(list(_MARKS.values()), axis=0)


def statistics(text: str) -> list[float]:
    """Transformed statistics of one text, in the order of STATISTICS."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    counts = np.bincount(data, minlength=256)
    size = len(data)
    words, lines = text.split(), text.split("\n")
    n = len(words)

    def ratio(part: float, whole: float) -> float:
        return float(np.log((part + 0.5) / (whole + 25.0)))

    shares = counts[counts > 0] / max(size, 1)
    return [
        float(np.log1p(len(text))),
        float(np.log1p(n)),
        float(np.log((size - counts[_SPACE].sum() + 1) / (n + 1))),
        ratio(counts[_UPPER].sum(), size),
        ratio(counts[_DIGIT].sum(), size),
        *(ratio(counts[m].sum(), size) for m in _MARKS.values()),
        ratio(counts[_OTHER].sum(), size),
        ratio(counts[128:].sum(), size),
        float(np.log((len(set(words)) + 1) / (n + 1))),
        float(np.log(len(set(lines)) / len(lines))),
        float(np.log1p(size / len(lines))),
        float(-(shares * np.log2(shares)).sum()),
        ratio(sum(map(str.istitle, words)), n),
    ]


def features(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``x`` array<double>."""

    def make():
        def step(texts):
            rows = np.array([statistics(t or "") for t in texts])
            edges = np.arange(len(texts) + 1, dtype=np.int32) * len(STATISTICS)
            return {"x": pa.ListArray.from_arrays(pa.array(edges), pa.array(rows.ravel()))}

        return step

    return map_texts(df, "x array<double>", make, text, keep)


@dataclass
class Model:
    """Per class 0 and 1: weight (log prior), mean, Cholesky factor and log determinant; or a constant."""

    constant: float | None
    classes: list[tuple[float, np.ndarray, np.ndarray, float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = []
        for weight, mean, factor, log_det in self.classes:
            y = np.linalg.solve(factor, (x - mean).T)
            logs.append(weight - 0.5 * log_det - 0.5 * (y * y).sum(axis=0))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def label_rows(labels: DataFrame) -> DataFrame:
    """(doc_id, label) with one row per labelled document."""
    known = labels.where("quality is not null and doc_id is not null")
    return known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))


def fit(rows: DataFrame, shrinkage: float = SHRINKAGE) -> Model:
    """Learn from ``x`` and ``label`` (0 or 1) of ``rows``."""
    d = len(STATISTICS)
    sums = [F.sum(F.col("x")[i]) for i in range(d)]
    products = [F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(d) for j in range(i, d)]
    found = {r[0]: r for r in rows.groupBy("label").agg(F.count("*"), F.array(*sums), F.array(*products)).collect()}
    if not {0, 1} <= found.keys():
        return Model(float(next(iter(found), 0.5)), [])
    moments = []
    for label in (0, 1):
        _, n, s, p = found[label]
        mean = np.array(s) / n
        square = np.zeros((d, d))
        square[np.triu_indices(d)] = p
        square = np.triu(square) + np.triu(square, 1).T
        moments.append((n, mean, square / n - np.outer(mean, mean)))
    total = sum(m[0] for m in moments)
    pooled = np.diag(sum(n * np.diag(c) for n, _, c in moments) / total + 1e-6)
    classes = []
    for n, mean, own in moments:
        factor = np.linalg.cholesky((1 - shrinkage) * own + shrinkage * pooled + 1e-9 * np.eye(d))
        classes.append((float(np.log(n / total)), mean, factor, float(2 * np.log(np.diag(factor)).sum())))
    return Model(None, classes)


def score(vectors: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, ``score`` and ``predicted`` from the ``x`` column."""
    source = vectors.select(*keep, F.col("x").alias("_x"))
    fields = source.select(*keep).schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "score double, predicted int"])

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            x = np.asarray(lists.flatten()).reshape(batch.num_rows, len(STATISTICS))
            s = model.score(x)
            columns = [*(batch.column(i) for i in range(len(keep))), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "score", "predicted"])

    return source.mapInArrow(run, schema)
