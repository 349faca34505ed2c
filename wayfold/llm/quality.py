"""Quality classifier: gradient-boosted trees over statistics of a document's bytes, words and lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Trees, fit
from .common import HIDDEN, small_batches, text_of

#: Labelled rows that the trees are fitted on at most: those of least hash, so that the choice doesn't depend on order.
TRAIN_ROWS = 12_000

_LOWER, _UPPER, _DIGIT, _BREAK, _BLANK, _STOP, _OTHER, _WIDE = range(8)


def _classes() -> np.ndarray:
    of = np.full(256, _OTHER)
    of[ord("a") : ord("z") + 1], of[ord("A") : ord("Z") + 1], of[ord("0") : ord("9") + 1] = _LOWER, _UPPER, _DIGIT
    of[[10, 13]], of[[9, 11, 12, 32]], of[[ord(c) for c in ".,;:?'\"-()"]], of[128:] = _BREAK, _BLANK, _STOP, _WIDE
    return of


_CLASS = _classes()
N_FEATURES = 26
#: A name for a column that documents don't have.
SCORE = "__quality_score__"


def statistics(texts: list[str]) -> np.ndarray:
    """A row of N_FEATURES numbers per text; an empty text has zeros."""
    out = np.zeros((len(texts), N_FEATURES))
    for row, text in zip(out, texts, strict=True):
        data = text.encode()
        if not data:
            continue
        hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        kinds = np.bincount(_CLASS, hist, 8)
        words, lines = data.split(), data.split(b"\n")
        n, size = max(1, len(words)), len(data)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
        distinct = len(set(words))
        same = sum(map(bytes.__eq__, words, words[1:]))
        pairs = len(set(zip(words, words[1:], strict=False)))
        row[:8] = kinds / size
        other = np.where(_CLASS == _OTHER, hist, 0)
        row[8] = other.max() / size
        row[9] = hist[ord("!")] / n
        row[10] = hist[ord("|")] / n
        row[11] = np.log1p(size)
        row[12] = np.log1p(len(words))
        row[13] = lengths.mean()
        row[14] = lengths.std()
        row[15] = np.log1p(lengths.max())
        row[16] = distinct / n
        row[17] = same / n
        row[18] = pairs / max(1, len(words) - 1)
        row[19] = len(set(lines)) / len(lines)
        row[20] = np.log1p(size / len(lines))
        row[21] = sum(w[:1].isupper() for w in words) / n
        row[22] = sum(w.isupper() for w in words) / n
        row[23] = kinds[_STOP] / n
        p = hist[hist > 0] / size
        row[24] = -(p * np.log(p)).sum()
        row[25] = np.log1p(distinct)
    return out


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row's labels are never learned from."""
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Trees:
    """Fit on at most `rows` labelled documents that aren't held out.

    Labels that are null are passed over; a document that several rows of labels mark, or that
    is there several times, counts once for each, but all in all no more than `rows` are taken:
    those of least hash. Null texts count as empty. Without any label, or without documents,
    the score is 0.5 everywhere.
    """
    small_batches(docs.sparkSession)
    chosen = (
        labels.where(~held_out(id_col) & F.col(label_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id", "_y")
        .limit(rows)
    )
    known = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select(F.xxhash64("_id", "_text").alias("_h"), "_text", "_y")  # `rows` bounds it

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(statistics(batch.column(1).to_pylist())), pa.list_(pa.float64())), batch.column(2)], ["h", "x", "y"])

    got = known.mapInArrow(measure, "h long, x array<double>, y int").orderBy("h", "x", "y").limit(rows).toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, N_FEATURES)
    y = got.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))
    return fit(x[order], y[order])


def score(docs: DataFrame, trees: Trees, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a column of the likelihood of good quality, from 0 to 1.

    Null texts count as empty, and an empty text has the score of its statistics, all zero. A
    column that already has the name of score_col is replaced; others pass unchanged, null ids
    too. Repeated rows get equal scores, an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != score_col]
    kept = docs.select(*[F.col(f"`{c}`") for c in names], text_of(text_col).alias(HIDDEN))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, text = batch.columns
            yield pa.RecordBatch.from_arrays([*columns, pa.array(trees.score(statistics(text.to_pylist())))], [*names, score_col])

    return kept.mapInArrow(run, T.StructType([*(docs.schema[c] for c in names), T.StructField(score_col, T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, held_out, score, predicted (1 from a score of 0.5).

    Null and empty texts have a score too. Repeated rows get equal scores; a row with a null id
    has held_out null, as no remainder is known. An empty table of documents gives no rows, an
    empty one of labels the score 0.5 for all.
    """
    trees = train(docs, labels, id_col, text_col)
    bare = docs.select(id_col, text_col)
    return score(bare, trees, text_col).select(
        id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, trees: Trees, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs with a score of at least `least`, with all their columns, whatever they are called."""
    return score(docs, trees, text_col, SCORE).where(F.col(SCORE) >= least).drop(SCORE)
