"""Quality classifier: Bradley-Terry scores from preference pairs.

A labelled good document is preferred to a labelled bad one. Scores are linear in features of the text: shares of symbols, capitals and repeats, and
hashed shares of words and of character trigrams. Their weights minimise the logistic loss on feature differences of the pairs. A quantile of
the training scores, at the share of bad labels, is the threshold, and the score given out is the logistic of the distance from it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality_rules

#: Bound on the labelled rows that are fitted: a seeded sample of at most so many.
MAX_TRAINING_ROWS = 20_000
PAIRS, STEPS, RIDGE = 40_000, 30, 1e-3
FEATURES = ("symbols", "capitals", "marks", "repeats", "dup_lines", "word_length", "length", "short", "symbols_root", "capitals_root", "repeats_square")
#: Buckets of word hashes and of character trigram hashes.
BUCKETS = 128
#: Bytes of a text whose trigrams are hashed together.
_BLOCK = 1 << 20


def ngram_shares(text: str | None) -> np.ndarray:
    """Square roots of the shares of a text's words and of its byte trigrams in BUCKETS hash buckets each; zeros without any."""
    import xxhash

    raw = (text or "").lower().encode("utf-8", "replace")
    out = np.zeros((2, BUCKETS))
    words = raw.split()
    if words:
        buckets = np.fromiter((xxhash.xxh3_64_intdigest(w) & (BUCKETS - 1) for w in words), np.int64, len(words))
        out[0] = np.bincount(buckets, minlength=BUCKETS) / len(words)
    for at in range(0, len(raw) - 2, _BLOCK):
        part = np.frombuffer(raw, np.uint8)[at : at + _BLOCK + 2].astype(np.uint32)
        mixed = (part[:-2] * np.uint32(0x9E3779B1) ^ part[1:-1] * np.uint32(0x85EBCA77) ^ part[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(25)
        out[1] += np.bincount(mixed, minlength=BUCKETS)
    out[1] /= max(1, len(raw) - 2)
    return np.sqrt(out).ravel()


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f array<double>, text, of the row): shares of the text alone, finite for empty texts too."""
    bare = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n = quality_rules.features(bare)
    chars = F.col("word_chars") + 1.0
    words = F.col("n_words") + 1.0
    symbols, capitals, repeats = F.col("n_symbols") / chars, F.col("n_upper") / chars, F.col("n_repeat_words") / words
    values = [
        symbols, capitals, F.col("n_mark") / chars, repeats, F.col("n_dup_lines") * 10.0 / words, F.least(F.lit(20.0), F.col("word_chars") / words) / 10,
        F.log(words) / 10, (F.col("n_words") < 20).cast("double"), F.sqrt(symbols), F.sqrt(capitals), repeats * repeats,
    ]
    return n.select("doc_id", F.array(*[v.cast("double") for v in values]).alias("f"), F.col("row.text").alias("text"))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights - self.threshold, -500, 500)))


def _vectors(batch: pa.RecordBatch, f: int, text: int) -> np.ndarray:
    """Features of the rows of a batch: the shares of column f and the n-grams of column text."""
    if not batch.num_rows:
        return np.zeros((0, len(FEATURES) + 2 * BUCKETS))
    shares = np.array(batch.column(f).to_pylist(), float)
    return np.hstack([shares, np.stack([ngram_shares(t) for t in batch.column(text).to_pylist()])])


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 7) -> Model:
    """Weights from pairs of a good and a bad row drawn with a seed; one class only: a model of constant score."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return Model(np.zeros(x.shape[1]), -20.0 if len(good) else 20.0)
    spread = x.std(axis=0)
    scale = np.where(spread > 0, spread, 1.0)
    rng = np.random.RandomState(seed)
    d = (good[rng.randint(0, len(good), pairs)] - bad[rng.randint(0, len(bad), pairs)]) / scale
    w = np.zeros(x.shape[1])
    for _ in range(STEPS):  # Newton steps on the mean logistic loss with a ridge
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + RIDGE * np.eye(len(w)), d.T @ p / pairs - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    s = np.sort((x / scale) @ w)
    low = int((y == 0).sum())  # so many rows lie below the threshold
    return Model(w / scale, float((s[low - 1] + s[low]) / 2))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Model from docs and labels(doc_id, quality). Of repeated labels of one doc_id contradicting ones count as none, equal ones once; repeated rows of docs count once."""
    once = labels.select(F.col("doc_id").alias("l_id"), "quality").where("quality in (0, 1)").groupBy("l_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = once.where("quality = other").select("l_id", "quality")
    n = own.select("doc_id").join(wanted, F.col("doc_id") == F.col("l_id")).count()
    order = F.xxhash64("doc_id")
    if n > 2 * max_rows:  # about twice the sample lies below this hash, so tasks send no more than that
        own = own.where(order < int(-(1 << 63) + (1 << 64) * (2 * max_rows / n)))
    # the sample is chosen by ids and hashes, at most max_rows of them; whole texts move only once they are chosen; of repeated rows one is taken
    hashes = own.select("doc_id", F.xxhash64("text").alias("h")).join(wanted, F.col("doc_id") == F.col("l_id"))
    slim = hashes.select("doc_id", "h", "quality").orderBy(order, "doc_id", "h").limit(max_rows).distinct()
    sent = F.broadcast(slim.select(F.col("doc_id").alias("c_id"), F.col("h").alias("c_h"), "quality"))
    chosen = own.join(sent, (F.col("doc_id") == F.col("c_id")) & (F.xxhash64("text") == F.col("c_h"))).dropDuplicates(["doc_id", "text"])
    featured = text_features(chosen.select(F.struct("doc_id", "quality").alias("doc_id"), "text")).select("doc_id.quality", "f", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch, 1, 2).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["y", "x"])

    rows = featured.mapInArrow(run, "y int, x binary").toArrow()
    if not rows.num_rows:
        return Model(np.zeros(len(FEATURES) + 2 * BUCKETS), 0.0)
    x = np.stack([np.frombuffer(r, "<f4") for r in rows.column("x").to_pylist()]).astype(float)
    y = rows.column("y").to_numpy()
    order_ = np.lexsort([*x.T[8:], *x.T[:8], y])  # rows come in any order; those equal in all features are interchangeable
    return fit(x[order_], y[order_])


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of docs.

    Labels whose crc32(doc_id as text) mod 3 is 1 are held out and never learnt from. Null texts count as empty and get
    a score like any other; a null doc_id has a null held_out; without usable labels each score is 0.5, with labels of one class each is
    near that class; repeated rows and an empty table give repeated rows and an empty result. Other columns are ignored.
    """
    held = lambda c: F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1
    model = train(docs, labels.where(~held("doc_id")), id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_vectors(batch, 1, 2)))], names=["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = text_features(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
