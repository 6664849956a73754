"""Quality classifier: a factorisation machine over words, structure and metadata."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import MAX_SAMPLE_CHARS, joined_sample
from .shared import fold, pieces

WORD_BUCKETS = 1 << 15
FACTORS = 8
#: Rows of each label that the model is fitted on, at most about this many.
PER_LABEL = 3000
THRESHOLD = 0.3

STATISTICS = ("letters", "digits", "punctuation", "upper", "lines", "words a line", "letters a word", "distinct words", "distinct lines", "longest word", "symbols at word ends", "lone symbols", "full stops", "log characters", "log words", "log distinct")
_KIND = np.array([1 if chr(b).isalpha() or b >= 128 else 2 if chr(b).isdigit() else 3 if b > 32 else 0 for b in range(256)], np.uint8)
_UPPER = np.array([65 <= b <= 90 for b in range(256)])


def statistics(raw: bytes, words: list[bytes], n_chars: int) -> np.ndarray:
    """Structure of the whole text and its one piece of metadata, the length; all finite for an empty text."""
    b = np.frombuffer(raw, np.uint8)
    n, k = max(1, len(b)), max(1, len(words))
    kinds = np.bincount(_KIND[b], minlength=4) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    last = np.fromiter((w[-1] for w in words), np.uint8, len(words))
    first = np.fromiter((w[0] for w in words), np.uint8, len(words))
    plain_end = np.isin(last, np.frombuffer(b".,;:!?)\"'", np.uint8))
    distinct = len(set(words))
    return np.array([
        kinds[1], kinds[2], kinds[3], _UPPER[b].sum() / n, m / k, np.log1p(k / m), np.log1p(sizes.mean() if len(sizes) else 0), distinct / k, len(set(lines)) / m, np.log1p(sizes.max() if len(sizes) else 0),
        ((_KIND[last] == 3) & ~plain_end).sum() / k, ((sizes == 1) & (_KIND[first] == 3)).sum() / k, (last == 46).sum() / k, np.log1p(n_chars), np.log1p(len(words)), np.log1p(distinct),
    ])


def features(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets, their L2-normalised weights, and the statistics, of the whole text."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    crc = zlib.crc32
    idx, n = np.unique(np.fromiter((crc(w) for w in raw.lower().split()), np.int64, len(words)) % WORD_BUCKETS, return_counts=True)
    weight = np.log1p(n)
    return idx, weight / max(1e-9, float(np.sqrt((weight**2).sum()))), statistics(raw, words, len(text))


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    constant: float | None = None

    def margin(self, text: str | None) -> float:
        """w0 + w.x + half of (sum of v x) squared less sum of (v x) squared: linear in the features."""
        idx, weight, stats = features(text)
        x = np.concatenate([weight, np.clip((stats - self.mean) / self.scale, -4, 4)])
        at = np.concatenate([idx, WORD_BUCKETS + np.arange(len(stats))])
        vx = self.factors[at] * x[:, None]
        return float(self.bias + self.linear[at] @ x + 0.5 * ((vx.sum(axis=0) ** 2).sum() - (vx**2).sum()))

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 / (1 + np.exp(-np.clip(self.margin(text), -30, 30))))


def fit(sample: list[tuple[str, int]], epochs: int = 12, rate: float = 0.05, decay: float = 1e-4, seed: int = 7, priors: dict | None = None) -> QualityModel:
    """Stochastic gradient descent on log loss.

    ``priors`` (rows of each label in the whole training fold) weigh the
    sampled rows back to the corpus, so scores are probabilities there.
    """
    labels = sorted({int(y) for _, y in sample})
    size = WORD_BUCKETS + len(STATISTICS)
    if len(labels) < 2:
        return QualityModel(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), 0.0, np.zeros(size), np.zeros((size, FACTORS)), float(labels[0]) if labels else 0.5)
    rng = np.random.default_rng(seed)
    rows = [(*features(t), int(y)) for t, y in sample]
    stats = np.array([r[2] for r in rows])
    mean, scale = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    drawn = {y: sum(r[3] == y for r in rows) for y in labels}
    weight = {y: (priors or drawn).get(y, drawn[y]) / drawn[y] for y in labels}
    top = sum(weight[y] * drawn[y] for y in labels) / len(rows)
    w, v, bias = np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)), 0.0
    gw, gv, gb = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    tail = WORD_BUCKETS + np.arange(len(STATISTICS))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            idx, wx, st, y = rows[i]
            at, x = np.concatenate([idx, tail]), np.concatenate([wx, np.clip((st - mean) / scale, -4, 4)])
            va = v[at]
            vx = va * x[:, None]
            total = vx.sum(axis=0)
            z = bias + w[at] @ x + 0.5 * ((total**2).sum() - (vx**2).sum())
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight[y] / top
            dw = g * x + decay * w[at]
            dv = g * (x[:, None] * (total - vx)) + decay * va
            gw[at] += dw**2
            gv[at] += dv**2
            gb += g * g
            w[at] -= rate * dw / np.sqrt(gw[at])
            v[at] -= rate * dv / np.sqrt(gv[at])
            bias -= rate * g / np.sqrt(gb)
    return QualityModel(mean, scale, float(bias), w.astype(np.float32), v.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = PER_LABEL, max_chars: int = MAX_SAMPLE_CHARS) -> QualityModel:
    """A model from a bounded sample of labelled documents outside the held-out fold: about ``per_label`` a label, of ``max_chars`` at most.

    Null labels, ids and texts teach nothing; of several labels of one id the
    larger counts. Labels other than 0 and 1 are an error. Without two labels
    the model is a constant: the only label, or one half.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    counts = marks.where(fold(id_col) != 0).groupBy("_label").count().limit(3).collect()
    if {int(r[0]) for r in counts} - {0, 1}:
        raise ValueError(f"{label_col} has other values than 0 and 1")
    return fit(joined_sample(docs, marks, "_label", per_label, id_col, text_col, max_chars), priors={int(r[0]): r[1] for r in counts})


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``doc_id, score``, from the whole text alone.

    Null texts score as empty ones, and very long ones whole, one at a time.
    Repeated rows give repeated rows, null ids stay null, an empty table
    gives none; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches):
            scores = [model.score(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    id_type = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, score double")
