"""A quality classifier: a linear hinge-loss model over n-gram indicators scaled by naive Bayes ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from ..session import ship
from .common import col, inner, small
from .textbytes import U64, Words, chunks, mix, string_buffers

_STEP = 0x9E3779B97F4A7C15
_BLOCK = 4096


@dataclass(frozen=True)
class Settings:
    """bits: features are hashed to 2**bits; sample_rows: labelled rows, about, that the hinge-loss model is fitted on;
    cost: of the hinge loss; smoothing: added to the counts of naive Bayes; epochs and seed of coordinate descent."""

    bits: int = 18
    sample_rows: int = 12000
    cost: float = 1.0
    smoothing: float = 1.0
    epochs: int = 8
    seed: int = 1


@dataclass(frozen=True)
class Model:
    """weights (of scaled indicators, the ratios multiplied in) and ratios by feature, the intercept and the number of labelled rows."""

    weights: np.ndarray
    ratios: np.ndarray
    intercept: float
    rows: int


def indicators(raw: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of each distinct n-gram of each text, sorted.

    n-grams are runs of one or two words, and runs of one or two separators: what stands
    between a word and the next (spaces, punctuation, line ends).
    """
    words = Words(raw, offsets)
    h, text = words.hash, words.text
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = words.gap_hashes()
    follows = np.zeros(n, dtype=bool)
    follows[:-1] = text[1:] == text[:-1]
    at = np.flatnonzero(follows)
    pair = mix(h[at] * U64(_STEP) + h[at + 1])
    gaps = mix(gap[at] * U64(_STEP) + gap[at + 1] + U64(3))
    keys = []
    for where, what in ((text, mix(h + U64(1))), (text[at], pair), (text, mix(gap + U64(2))), (text[at], gaps)):
        keys.append((where.astype(U64) << U64(32)) | (what >> U64(64 - bits)))
    keys = np.concatenate(keys)
    keys.sort()
    first = np.ones(len(keys), dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=first[1:])
    keys = keys[first]
    return (keys >> U64(32)).astype(np.int64), (keys & U64(0xFFFFFFFF)).astype(np.int64)


def _count(bits: int):
    """Rows (text, label) to (block, rows of the task's counts by class as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bits), np.int32)
        rows = np.zeros(2, np.int64)
        for batch in batches:
            raw, off = string_buffers(batch.column(0))
            label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            rows += np.bincount(label, minlength=2)[:2]
            for i, j in chunks(off):
                text, feature = indicators(raw[off[i] : off[j]], off[i : j + 1] - off[i], bits)
                both = np.bincount(feature + (label[i:j][text] << bits), minlength=2 << bits)
                counts += both.reshape(2, -1).astype(np.int32)
        if rows.sum():
            at = np.arange(0, 1 << bits, _BLOCK)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at // _BLOCK, pa.int32()), pa.array([rows[0]] * len(at)), pa.array([rows[1]] * len(at)), pa.array([counts[:, a : a + _BLOCK].astype(np.int64).tobytes() for a in at], pa.binary())],
                names=["block", "negative", "positive", "counts"],
            )

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of rows of _count by block."""
    sums: dict[int, list] = {}
    for batch in batches:
        for block, negative, positive, counts in zip(*(batch.column(k).to_pylist() for k in range(4))):
            have = np.frombuffer(counts, np.int64)
            was = sums.get(block)
            sums[block] = [negative, positive, have.copy()] if was is None else [was[0] + negative, was[1] + positive, was[2] + have]
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1] for x in sums.values()], pa.int64()), pa.array([x[2].tobytes() for x in sums.values()], pa.binary())], names=["block", "negative", "positive", "counts"])


def log_count_ratios(counts: np.ndarray, smoothing: float) -> np.ndarray:
    """Of counts (2, features): the log of the positive class's share of each feature over the negative's."""
    shares = counts + smoothing
    shares = shares / shares.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(starts: np.ndarray, features: np.ndarray, values: np.ndarray, label: np.ndarray, size: int, cost: float, epochs: int, seed: int) -> np.ndarray:
    """The weights (size + 1, the last the intercept) that minimise |w|^2 / 2 + cost * sum of hinge losses.

    Row i has the features[starts[i]:starts[i + 1]] and a constant 1; label is +1 or -1.  One
    dual variable at a time is brought to its optimum within [0, cost], in a new random order each epoch.
    """
    w = np.zeros(size + 1)
    n = len(label)
    alpha = np.zeros(n)
    squares = np.add.reduceat(np.append(values * values, 0.0), starts[:-1]) * (np.diff(starts) > 0) + 1.0
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(n):
            a, b = starts[i], starts[i + 1]
            f, v, y = features[a:b], values[a:b], label[i]
            gradient = y * (v @ w[f] + w[size]) - 1.0
            new = min(max(alpha[i] - gradient / squares[i], 0.0), cost)
            step = (new - alpha[i]) * y
            if step:
                w[f] += step * v
                w[size] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4 * cost:
            break
    return w


def scaled(text: np.ndarray, feature: np.ndarray, ratios: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(values of the scaled indicators, each text's of length 1, and the factor of each text that made it so)."""
    value = ratios[feature]
    norm = np.sqrt(np.bincount(text, weights=value * value, minlength=texts))
    factor = np.divide(1.0, norm, out=np.zeros(texts), where=norm > 0)
    return value * factor[text], factor


def _train(ratios: np.ndarray, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, values, sizes, labels = [], [], [], []
        for batch in batches:
            raw, off = string_buffers(batch.column(0))
            labels.append(batch.column(1).to_numpy(zero_copy_only=False))
            for i, j in chunks(off):
                text, feature = indicators(raw[off[i] : off[j]], off[i : j + 1] - off[i], settings.bits)
                features.append(feature.astype(np.int32))
                values.append(scaled(text, feature, ratios, j - i)[0].astype(np.float32))
                sizes.append(np.bincount(text, minlength=j - i))
        if labels:
            starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            label = np.where(np.concatenate(labels) > 0, 1.0, -1.0)
            w = dual_coordinate_descent(starts, np.concatenate(features), np.concatenate(values).astype(np.float64), label, 1 << settings.bits, settings.cost, settings.epochs, settings.seed)
            yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary())], names=["w"])

    return run


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model | None:
    """The classifier that labels (id, label 0 or 1) teach; None if either class has no text.

    The class counts, from which the log-count ratios come, are of all labelled rows: each
    task counts into two dense arrays, which are summed by blocks of features.  The
    hinge-loss model is fitted in one task on those rows whose hash of the id is below
    sample_rows / rows, a sample of about sample_rows rows whatever the number of rows.

    Rows of a null id, text or label, and ids of contradicting labels, don't count; repeated labels count once.
    """
    ship()
    known = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").select("id", "label")
    texts = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    labelled = texts.join(small(known, known.count(), 24), "id").select("text", "label", "id")
    kind = "block int, negative bigint, positive bigint, counts binary"
    blocks = labelled.select("text", "label").mapInArrow(_count(settings.bits), kind).repartition("block").mapInArrow(_add, kind).collect()
    if not blocks or not blocks[0]["negative"] or not blocks[0]["positive"]:
        return None
    counts = np.concatenate([np.frombuffer(b["counts"], np.int64).reshape(2, -1) for b in sorted(blocks, key=lambda b: b["block"])], axis=1)
    ratios = log_count_ratios(counts, settings.smoothing)
    rows = blocks[0]["negative"] + blocks[0]["positive"]
    share = min(1.0, settings.sample_rows / rows)
    drawn = labelled.where(F.pmod(F.xxhash64(F.lit(settings.seed), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    got = drawn.repartition(1).sortWithinPartitions("id", "text").select("text", "label").mapInArrow(_train(ratios, settings), "w binary").collect()
    if not got:
        return None
    w = np.frombuffer(got[0]["w"], np.float64)
    return Model((w[:-1] * ratios).astype(np.float32), ratios.astype(np.float32), float(w[-1]), rows)


def _score(model: Model, bits: int):
    """Rows whose last column is the text to the other columns and their score."""
    weights, squares = model.weights, model.ratios.astype(np.float64) ** 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = string_buffers(batch.columns[-1])
            score = np.full(batch.num_rows, model.intercept)
            for i, j in chunks(off):
                text, feature = indicators(raw[off[i] : off[j]], off[i : j + 1] - off[i], bits)
                norm = np.sqrt(np.bincount(text, weights=squares[feature], minlength=j - i))
                total = np.bincount(text, weights=weights[feature], minlength=j - i)
                score[i:j] += np.divide(total, norm, out=np.zeros(j - i), where=norm > 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], names=[*batch.schema.names[:-1], "score"])

    return run


def score(docs: DataFrame, model: Model | None, settings: Settings = Settings(), keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns keep of docs, and score: above 0 for the positive class; a kept column of that name is replaced.

    Texts are scored whole, in a map without a shuffle.  A null text, or one without words, gets the intercept; with no
    model every score is 0; repeated rows are each scored; an empty table gives no rows; of other columns only those in keep are read.
    """
    ship()
    held = [col(c) for c in keep if c.lower() != "score"]
    if model is None:
        return docs.select(*held, F.lit(0.0).alias("score"))
    rows = docs.select(*held, col(text_col).cast("string").alias(inner(docs)("text")))
    kind = StructType(rows.schema.fields[:-1]).add("score", DoubleType())
    return rows.mapInArrow(_score(model, settings.bits), kind)


def classify(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.0, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns keep of docs, score and kept: whether the score is at threshold or above, or the text has no words to judge by.

    Columns of keep that are named score or kept are replaced.  Null and empty texts, and those without a word, are
    kept; where the labels don't have both classes all are kept at a score of 0; repeated rows are judged alike; a null id is kept
    as it is; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    wordless = inner(docs)("wordless")
    none = ~F.coalesce(col(text_col).cast("string"), F.lit("")).rlike(r"[A-Za-z0-9\x{80}-\x{10FFFF}]")
    held = tuple(c for c in keep if c.lower() != "kept")
    made = score(docs.withColumn(wordless, none), fit(docs, labels, settings, text_col=text_col), settings, (*held, wordless), text_col)
    return made.withColumn("kept", (F.col("score") >= threshold) | F.col(wordless)).drop(wordless)
