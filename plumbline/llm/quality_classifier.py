"""Quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

Texts are read once, into some thirty statistics a document. Random Fourier features of the
standardized statistics approximate a Gaussian kernel; each partition sums its part of the normal
equations, so fitting moves a fixed number of sums a task and solves one small system. Raw scores
become probabilities by isotonic regression on scores of models that did not see the row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.storage import pin
from plumbline.llm.tables import by_batch, read
from plumbline.llm.texts import Words, chunks, covered, in_document, per_document, seen_twice

#: Random Fourier features, width of the kernel in standard deviations, ridge by training row.
FEATURES, WIDTH, RIDGE = 256, 6.0, 1e-3
#: Raw scores are counted in so many steps of [-0.5, 1.5] for the isotonic fit.
STEPS, LOWEST, HIGHEST = 1000, -0.5, 1.5
FOLDS = 3
HELD_OUT = 1

_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" ",
    "tab": b"\t",
    "newline": b"\n",
    "stop": b".",
    "comma": b",",
    "exclamation": b"!",
    "question": b"?",
    "symbol": b"#*$%&|<>",
    "bracket": b"()[]{}",
    "quote": b"'\"`",
    "dash": b"-_/\\",
    "other_ascii": b":;@^~+=",
    "high": bytes(range(128, 256)),
}


def statistics(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """One row of statistics for each document of a chunk."""
    words = Words(offsets, data)
    docs, size = words.docs, np.maximum(np.diff(offsets), 1).astype(float)
    at = np.repeat(np.arange(docs) << 8, np.diff(offsets)) + data
    seen = np.bincount(at, minlength=docs << 8).reshape(docs, 256).astype(float)
    share = seen / size[:, None]
    columns = [share[:, list(group)].sum(1) for group in _CLASSES.values()]
    columns.append(-(share * np.log(np.where(share > 0, share, 1))).sum(1))
    n = np.maximum(words.count, 1).astype(float)
    length = (words.end - words.start).astype(float)
    mean = np.bincount(words.doc, length, docs) / n
    squares = np.bincount(words.doc, length**2, docs) / n
    columns += [np.log1p(np.diff(offsets)), np.log1p(words.count), mean, np.sqrt(np.maximum(squares - mean**2, 0))]
    for mark in (length == 1, length > 20, *_first_and_last(words)):
        columns.append(np.bincount(words.doc[mark], minlength=docs) / n)
    columns.append(np.log1p((words.count) / (1 + seen[:, 10])))
    again = seen_twice(in_document(words.hash, words.doc))
    columns.append(np.bincount(words.doc[again], minlength=docs) / n)
    for k in (2, 5):
        place, hashes = words.grams(k)
        inside = covered(len(words.start), place[seen_twice(in_document(hashes, words.doc[place]))], k)
        columns.append(per_document(words.doc[inside], docs) / n)
    return np.stack(columns, 1)


def _first_and_last(words: Words) -> list[np.ndarray]:
    """Words that begin with a capital, end in a stop, end in a symbol."""
    first, last = words.data[words.start], words.data[words.end - 1]
    capital = (first >= 65) & (first <= 90)
    letter = ((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128)
    return [capital, np.isin(last, list(b".!?")), ~letter]


def document_statistics(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id and statistics of every row's whole text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, end, offsets, data in chunks(batch):
            found = statistics(offsets, data)
            ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1])
            cells = pa.ListArray.from_arrays(ends, pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first), cells], ["doc_id", "stats"]
            )

    frame = df.select(df[key].alias("doc_id"), df[text].cast("string").alias("text"))
    return by_batch(frame, run, f"doc_id {kind}, stats array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


@dataclass
class Model:
    """Everything that scores a row of statistics; its size is fixed."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray  # one column for each left-out fold and, last, for none
    steps: np.ndarray | None = None  # raw scores and what they stand for
    values: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        cosine = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / FEATURES)
        return np.concatenate((np.ones((len(z), 1)), z, cosine), 1)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp((self.features(stats) @ self.weights)[:, -1], self.steps, self.values)


def _moments(train: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(width), np.zeros(width)
        for batch in batches:
            stats = _matrix(batch.column(0))
            n, total, squares = n + len(stats), total + stats.sum(0), squares + (stats**2).sum(0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(total), pa.array(squares)],
            ["place", "n", "total", "squares"],
        )

    rows = (
        train.select("stats").mapInArrow(run, "place long, n long, total double, squares double")
        .groupBy("place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"))
        .collect()
    )
    mean, scale = np.zeros(width), np.ones(width)
    for row in rows:
        if row["n"]:
            mean[row["place"]] = row["total"] / row["n"]
            spread = row["squares"] / row["n"] - mean[row["place"]] ** 2
            scale[row["place"]] = np.sqrt(spread) if spread > 1e-12 else 1.0
    return mean, scale


def _normal_equations(train: DataFrame, model: Model, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By fold: Gram matrix, right-hand side and rows. The label is one more column of the matrix."""
    upper = np.triu_indices(size + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, size + 1, size + 1))
        for batch in batches:
            z = np.concatenate((model.features(_matrix(batch.column(0))), np.asarray(batch.column(1))[:, None]), 1)
            fold = np.asarray(batch.column(2))
            for f in np.unique(fold):
                sums[f] += z[fold == f].T @ z[fold == f]
        for f in range(FOLDS):
            if sums[f, 0, 0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(upper[0]), f)), pa.array(np.arange(len(upper[0]))), pa.array(sums[f][upper])],
                    ["fold", "cell", "total"],
                )

    rows = (
        train.select("stats", "label", "fold").mapInArrow(run, "fold long, cell long, total double")
        .groupBy("fold", "cell").agg(F.sum("total").alias("total")).toPandas()
    )
    full = np.zeros((FOLDS, size + 1, size + 1))
    cell = rows["cell"].to_numpy(np.int64)
    full[rows["fold"].to_numpy(np.int64), upper[0][cell], upper[1][cell]] = rows["total"].to_numpy(float)
    full = full + np.triu(full, 1).transpose(0, 2, 1)
    return full[:, :size, :size], full[:, :size, size], full[:, 0, 0]


def _ridge(gram: np.ndarray, right: np.ndarray, rows: float) -> np.ndarray:
    penalty = np.full(len(right), RIDGE * max(rows, 1.0))
    penalty[0] = 1e-9  # the constant is not shrunk
    return np.linalg.lstsq(gram + np.diag(penalty), right, rcond=None)[0]


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Nearest non-decreasing sequence, by pooling neighbours that violate the order."""
    pooled: list[list[float]] = []
    for value, weight in zip(values, weights):
        pooled.append([value, weight, 1])
        while len(pooled) > 1 and pooled[-2][0] >= pooled[-1][0]:
            b, a = pooled.pop(), pooled.pop()
            total = a[1] + b[1]
            pooled.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in pooled]) if pooled else np.zeros(0)


def _calibrate(train: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Raw scores and probabilities between which later scores are interpolated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, good = np.zeros(STEPS, np.int64), np.zeros(STEPS)
        for batch in batches:
            raw = model.features(_matrix(batch.column(0))) @ model.weights
            raw = raw[np.arange(len(raw)), np.asarray(batch.column(2))]
            step = np.clip((raw - LOWEST) / (HIGHEST - LOWEST) * STEPS, 0, STEPS - 1).astype(int)
            count += np.bincount(step, minlength=STEPS)
            good += np.bincount(step, np.asarray(batch.column(1)), STEPS)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(count[used]), pa.array(good[used])], ["step", "rows", "good"]
        )

    rows = (
        train.select("stats", "label", "fold").mapInArrow(run, "step long, rows long, good double")
        .groupBy("step").agg(F.sum("rows").alias("rows"), F.sum("good").alias("good")).orderBy("step").collect()
    )
    if not rows:
        return np.array([0.0]), np.array([0.5])
    weight = np.array([r["rows"] for r in rows], float)
    steps = LOWEST + (np.array([r["step"] for r in rows]) + 0.5) * (HIGHEST - LOWEST) / STEPS
    return steps, isotonic(np.array([r["good"] for r in rows]) / weight, weight)


def fold_of(key: Column) -> Column:
    """crc32 of the key as text, modulo 3; null without a key."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(FOLDS)).cast("int")


def fit(train: DataFrame, width: int, seed: int = 5) -> Model:
    """A model of rows with stats, label (0 or 1) and fold; 0.5 for all where there is no row."""
    draw = np.random.default_rng(seed)
    mean, scale = _moments(train, width)
    model = Model(
        mean, scale, draw.normal(0, 1 / WIDTH, (width, FEATURES)), draw.uniform(0, 2 * np.pi, FEATURES), np.zeros(0)
    )
    size = 1 + width + FEATURES
    gram, right, rows = _normal_equations(train, model, size)
    models = [
        _ridge(gram.sum(0) - gram[f], right.sum(0) - right[f], rows.sum() - rows[f]) for f in range(FOLDS)
    ]
    model.weights = np.stack([*models, _ridge(gram.sum(0), right.sum(0), rows.sum())], 1)
    model.steps, model.values = _calibrate(train, model)
    return model


def learn(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Model:
    """A model of all labelled rows that are not held out."""
    width = statistics(np.zeros(2, np.int64), np.zeros(0, np.uint8)).shape[1]
    known = labels.select(labels[key].alias("doc_id"), labels[label].cast("double").alias("label")).where("label in (0, 1)")
    known = known.withColumn("fold", fold_of(F.col("doc_id"))).where(F.col("fold") != HELD_OUT)
    return fit(pin(stats.join(known, "doc_id").select("stats", "label", "fold")), width)


def classify(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    others: tuple[str, ...] = (),
) -> DataFrame:
    """held_out, score (0 to 1) and predicted (1 if score >= 0.5) of every row's whole text.

    Labels are learned from rows whose crc32(key as text) modulo 3 is not 1; those rows are held
    out. All other labelled rows are learned from; none is sampled. Labels other than 0 and 1 are
    not learned; a key with several labels counts with each. Null and empty texts are scored as a
    text of no words. Rows without a key are scored, are not held out and meet no label; repeated
    rows are scored each. The columns ``others`` are passed on, which reads the texts once more;
    the rest is not read. Without labels every score is 0.5; an empty table gives an empty result.
    """
    stats = pin(document_statistics(df, key, text))
    model = learn(stats, labels, key, label)

    def scores(found: np.ndarray) -> pa.Array:
        return pa.array(np.clip(model.score(found), 0, 1) if len(found) else np.zeros(0))

    def stored(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), scores(_matrix(batch.column(1)))], ["doc_id", "score"])

    def again(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first, end, offsets, data in chunks(batch, batch.schema.names[1]):
            part = [c.slice(first, end - first) for c in (batch.column(0), *batch.columns[2:])]
            yield pa.RecordBatch.from_arrays(
                [*part, scores(statistics(offsets, data))], ["doc_id", *batch.schema.names[2:], "score"]
            )

    if others:
        given = df.select(
            df[key].alias("doc_id"), df[text].cast("string").alias("judged text"),
            *[df[c].alias(f"o{i}") for i, c in enumerate(others)],
        )
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema if f.name != "judged text")
        scored = by_batch(given, again, f"{kinds}, score double")
    else:
        scored = by_batch(stats, stored, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select(
        "doc_id",
        F.coalesce(fold_of(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        *[F.col(f"o{i}").alias(c) for i, c in enumerate(others)],
    )


def op8_fourier_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op8_fourier_quality": (op8_fourier_quality, None)}
