"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import MAX_SAMPLE_CHARS, labelled_sample
from .shared import pieces

BUCKETS = 1 << 16
DIMENSIONS = 16
#: Bytes of a subword.
GRAMS = (3, 4)
#: Rows of each language that the model is fitted on, at most about this many.
PER_LANGUAGE = 800
UNKNOWN = "und"
#: Bits of the table that says which subwords the fitted texts had.
KNOWN_BITS = 20
#: Share of rightly named calibration texts that may fall below twice the rejection threshold.
FALSE_REJECTION = 0.005
#: Calibration texts from which a language is judged by its own; half as many of all languages must there be to reject any text as strange.
LEAST_CALIBRATION = 20
#: Deviations of a subword that a text may be stranger than the strangest calibration text.
SLACK = 0.75
#: Standard errors that a text's mean familiarity may lie lower because the text is short.
ERRORS = 4.0

# ASCII letters go to lower case, other ASCII becomes a space; bytes of longer characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def hashes(text: str) -> np.ndarray:
    """Hashes of all subwords of the text, in lower case; spaces mark word ends."""
    raw = (" " + text.lower() + " ").encode("utf-8", "replace").translate(_FOLD)
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    b = b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]]  # a run of spaces counts once
    out = []
    for n in GRAMS:
        if len(b) < n:
            continue
        h = np.full(len(b) - n + 1, n, np.uint32)
        for i in range(n):
            h = h * np.uint32(0x01000193) + b[i : len(b) - n + 1 + i]
        out.append(h * np.uint32(0x9E3779B1))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def buckets(h: np.ndarray) -> np.ndarray:
    """Embedding buckets of subword hashes."""
    return h >> np.uint32(16)


def familiarity(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """How well the fitted texts know each subword, 0 for one they never had."""
    return known[h >> np.uint32(32 - KNOWN_BITS)]


def has_letter(text: str | None) -> bool:
    """Whether any character is alphabetic."""
    return text is not None and any(map(str.isalpha, text))


@dataclass
class LanguageModel:
    """``table`` holds each bucket's embedding already multiplied by the softmax weights.

    The average of embeddings and the softmax weights are both linear, so a
    text's logits are the mean of its buckets' rows plus ``bias``. ``known``
    holds the logarithm of each subword's count in the fitted texts;
    ``usual`` has its mean and deviation over a subword of each language and
    how far below that a text's mean may lie.
    """

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    known: np.ndarray = field(default_factory=lambda: np.zeros(1 << KNOWN_BITS, np.float32))
    usual: np.ndarray | None = None
    temperature: float = 1.0
    threshold: float = 0.0
    accuracy: float = field(default=float("nan"))

    def logits(self, h: np.ndarray) -> np.ndarray:
        return (self.table[buckets(h)].mean(axis=0, dtype=np.float64) if len(h) else np.zeros(len(self.languages))) + self.bias

    def strangeness(self, h: np.ndarray, language: int) -> float:
        """How far the text's mean familiarity lies below the language's, beyond what its length excuses."""
        mean, deviation = self.usual[language][:2]
        return float(mean - familiarity(h, self.known).mean(dtype=np.float64) - ERRORS * deviation / np.sqrt(len(h)))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated probability and whether it is accepted; ``und``, 0 and no for null and for a text without a letter."""
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, False
        h = hashes(text)
        z = self.logits(h) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        strange = self.usual is not None and len(h) > 0 and self.strangeness(h, best) > self.usual[best][2]
        return self.languages[best], float(p[best]), bool(p[best] >= self.threshold and not strange)


def fit(sample: list[tuple[str, str]], epochs: int = 6, rate: float = 0.5, seed: int = 7) -> LanguageModel:
    """Stochastic gradient descent over ``sample``; a fifth is set aside for calibration.

    The temperature is the one of a grid with the least log loss on that
    fifth. A text is rejected when its probability is below half of what all
    but one in ``1 / FALSE_REJECTION`` rightly named calibration texts reach,
    or when its subwords are stranger to the fitted texts than those of any
    rightly named calibration text of the language: foreign languages,
    keyboard noise and shuffled letters. Texts like those of the sample pass.
    """
    sample = [(t, str(y)) for t, y in sample if has_letter(t)]
    languages = sorted({y for _, y in sample})
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(sample))
    held = set(order[: len(sample) // 5].tolist()) if len(sample) >= 50 else set()
    rows, counts = [], np.zeros(1 << KNOWN_BITS, np.int64)
    for i, (t, y) in enumerate(sample):
        if i not in held:
            h = hashes(t)
            np.add.at(counts, h >> np.uint32(32 - KNOWN_BITS), 1)
            idx, n = np.unique(buckets(h), return_counts=True)
            rows.append((idx, (n / max(1, n.sum())).astype(np.float32), languages.index(y)))
    e = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    w = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps = epochs * len(rows)
    for step in range(steps):
        if step % len(rows) == 0:
            turn = rng.permutation(len(rows))
        idx, share, y = rows[turn[step % len(rows)]]
        lr = rate * (1 - step / steps)
        mean = share @ e[idx]
        z = mean @ w + bias
        g = np.exp(z - z.max())
        g /= g.sum()
        g[y] -= 1
        back = w @ g
        w -= lr * np.outer(mean, g)
        bias -= lr * 0.1 * g
        # the gradient of a bucket is its share, scaled up so that rare subwords move in few epochs
        e[idx] -= (lr * 20) * share[:, None] * back
    model = LanguageModel(languages, (e @ w).astype(np.float32), bias.astype(np.float64), np.log1p(counts).astype(np.float32))
    kept = [(hashes(sample[i][0]), languages.index(sample[i][1])) for i in sorted(held)]
    if kept:
        _calibrate(model, kept)
    return model


def _calibrate(model: LanguageModel, kept: list[tuple[np.ndarray, int]]) -> None:
    """Set temperature, threshold and the usual familiarity from texts that the model was not fitted on."""
    z, y = np.array([model.logits(h) for h, _ in kept]), np.array([b for _, b in kept])

    def probabilities(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    loss = {t: -np.log(np.maximum(probabilities(t)[np.arange(len(y)), y], 1e-12)).mean() for t in np.geomspace(0.2, 5, 25)}
    model.temperature = float(min(loss, key=loss.get))
    p = probabilities(model.temperature)
    right = p.argmax(axis=1) == y
    model.accuracy = float(right.mean())
    if not right.any():
        return
    model.threshold = 0.5 * float(np.quantile(p.max(axis=1)[right], FALSE_REJECTION))
    model.usual = np.full((len(model.languages), 3), [0.0, 0.0, np.inf])
    known = [(familiarity(h, model.known), h, b) for (h, b), r in zip(kept, right) if r and len(h)]
    for k in range(len(model.languages)):
        # A language with few calibration texts is judged by those of all languages.
        mine = [x for x in known if x[2] == k]
        mine = mine if len(mine) >= LEAST_CALIBRATION else known
        if len(mine) < LEAST_CALIBRATION // 2:
            continue  # too few to tell strange texts from: none is rejected as strange
        model.usual[k, 0] = np.mean([f.mean(dtype=np.float64) for f, _, _ in mine])
        model.usual[k, 1] = np.mean([f.std(dtype=np.float64) for f, _, _ in mine])
        worst = max(model.strangeness(h, k) for _, h, _ in mine)
        model.usual[k, 2] = max(0.0, worst) + SLACK * model.usual[k, 1]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, max_chars: int = MAX_SAMPLE_CHARS) -> LanguageModel:
    """A model from a bounded sample of the rows outside the held-out fold: about ``per_language`` a language, of ``max_chars`` at most."""
    return fit(labelled_sample(docs, lang_col, per_language, id_col, text_col, max_chars))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: ``doc_id, lang_pred, score, accepted``, from the whole text alone.

    ``und`` with score 0 for null texts, texts without a letter and a model
    without languages; those are never accepted. Other texts are accepted
    when the calibrated probability reaches the model's threshold and their
    subwords are not strange to the language. Very long texts are taken one
    at a time. Repeated rows give repeated rows; an empty table gives none;
    other columns are not read.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in pieces(batches):
            lang, score, accepted = zip(*[model.predict(t) for t in batch.column("text").to_pylist()])
            yield pa.record_batch([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    id_type = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double, accepted boolean")


def keep_accepted(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that the model rejects, as they came in, whatever columns they have.

    Null texts, texts without a letter and all texts under a model without
    languages go; ids play no part, so null and repeated ones stay. Texts
    are taken from their batch one at a time, whatever their length; an empty
    table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def accepted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        for some in texts:
            yield pa.array((model.predict(t.as_py())[2] for t in some), pa.bool_())

    return docs.where(accepted(F.col(text_col)))
