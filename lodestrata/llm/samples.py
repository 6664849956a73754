"""Bounded, repeatable samples of labelled rows to fit models on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold, id_key

#: A sample never takes longer texts, so its bytes are bounded as its rows are. Scoring takes every text whole.
MAX_SAMPLE_CHARS = 20_000
MAX_CLASSES = 1000


def _chosen(known: DataFrame, label: str, per_class: int, id_col: str) -> DataFrame:
    """Rows of ``known`` by a hash of the id, so many of each class that about ``per_class`` are expected."""
    counts = {r[0]: r[1] for r in known.groupBy(label).count().limit(MAX_CLASSES + 1).collect()}
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label}")
    if not counts:
        return known.limit(0)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_class / n))])
    at = F.pmod(id_key(id_col), F.lit(1 << 30)) / float(1 << 30)
    return known.where(at < share[F.col(label)])


def labelled_sample(docs: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", max_chars: int = MAX_SAMPLE_CHARS) -> list[tuple[str, object]]:
    """About ``per_class`` ``(text, label)`` rows of each class, outside the held-out fold, on the driver.

    Rows are chosen by a hash of the id, so every run chooses the same ones.
    Null labels, null texts, null ids and texts beyond ``max_chars`` are left out.
    """
    known = docs.where(F.col(label).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col) != 0)).where(F.char_length(text_col) <= max_chars)
    rows = _chosen(known, label, per_class, id_col).select(id_col, text_col, label).toPandas()
    rows = rows.sort_values([id_col, text_col], kind="stable")
    return list(zip(rows[text_col], rows[label]))


def joined_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", max_chars: int = MAX_SAMPLE_CHARS) -> list[tuple[str, object]]:
    """Like :func:`labelled_sample` with the labels in a table of their own, a row an id.

    Ids are chosen from the labels alone. They are at most a few thousand, so
    they go to the documents; the texts stay where they are.
    """
    chosen = _chosen(labels.where(F.col(label).isNotNull() & (fold(id_col) != 0)), label, per_class, id_col).select(F.col(id_col).alias("_id"), F.col(label).alias("_label"))
    rows = docs.select(id_col, text_col).where(F.char_length(text_col) <= max_chars).join(F.broadcast(chosen), F.col(id_col) == F.col("_id")).select("_id", text_col, "_label").toPandas()
    rows = rows.sort_values(["_id", text_col], kind="stable")
    return list(zip(rows[text_col], rows["_label"]))
