"""Quality scores from compressed sizes.

Two zstandard dictionaries are trained, one on chunks of good labelled documents and one on chunks of bad ones. A text is
cut into chunks of CHUNK characters, so that the dictionary and not the text's own beginning explains it, and every chunk
is compressed with both. The features are sizes alone: the normalised difference of the two totals, the largest and the
smallest normalised difference of a chunk, the total under the bad dictionary over the raw size, and the raw size. A
logistic model turns them into a score; it is fitted on labelled documents that the dictionaries have not seen, and
features beyond the range it saw count as that range's end. (The total under the good dictionary is no feature of its own:
a good document that the dictionary was made from would look like a repetitive one.)

Fitting reads at most DOCUMENTS labelled documents of each class for the dictionaries and as many for calibration (those
with the lowest seeded hash of their id) and at most CHUNKS chunks of each class. Scoring reads every text whole.

Cases: a null or empty text, which has no sizes, scores the share of good documents among the calibration rows. A row
with a null label is not learnt from. A null id is never learnt from and is not held out. Repeated rows score alike.
Without bad (or good) labelled rows every document scores 1 (or 0), and without labels 0.5. Columns beyond the id and the
text are never read. An empty table has no scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.llm.words import frees

DOCUMENTS, CHUNKS, CHUNK = 1500, 6000, 2000
DICTIONARY_BYTES, LEVEL, SEED = 48 << 10, 3, 11
FOLDS, HELD_OUT = 3, 1


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    empty: float


def fold(key: Column, folds: int) -> Column:
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def held_out(key: Column, folds: int = FOLDS, which: int = HELD_OUT) -> Column:
    return F.coalesce(fold(key, folds) == which, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, part: int) -> list[tuple[int, str]]:
    """(label, text) of at most DOCUMENTS documents of each class in a fold. Their number bounds the broadcast."""
    rows = labels.filter(fold(F.col("doc_id"), FOLDS) == part)
    chosen: dict[int, int] = {}
    for label in (0, 1):
        lowest = rows.filter(F.col("quality") == label).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id")
        chosen |= {r[0]: label for r in lowest.limit(DOCUMENTS).collect()}
    if not chosen:
        return []
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(list(chosen.items()), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int"))
    found = docs.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))
    # An id may repeat; one text of it is enough to learn from.
    first = found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).orderBy("doc_id")
    return [(r["label"], r["text"]) for r in first.toLocalIterator()]


def chunks(text: str) -> list[bytes]:
    return [text[i : i + CHUNK].encode() for i in range(0, len(text), CHUNK)]


def _train(texts: list[str]) -> bytes:
    pieces = [c for t in texts for c in chunks(t)]
    order = np.random.default_rng(SEED).permutation(len(pieces))[:CHUNKS]
    samples = [pieces[i] for i in order]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 3)), samples).as_bytes()
    except zstandard.ZstdError:  # too few samples: their own content serves
        return b"\n".join(samples)[-DICTIONARY_BYTES:]


class Sizes:
    """Features of texts under the two dictionaries; one per task."""

    def __init__(self, good: bytes, bad: bytes):
        made = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (good, bad)]
        self.good, self.bad = (m.compress for m in made)

    def features(self, text: str) -> list[float] | None:
        pieces = chunks(text)
        if not pieces:
            return None
        raw = np.array([len(c) for c in pieces], dtype=float)
        good = np.array([len(self.good(c)) for c in pieces], dtype=float)
        bad = np.array([len(self.bad(c)) for c in pieces], dtype=float)
        each = (good - bad) / (raw + 20)
        total = raw.sum()
        return [1.0, (good.sum() - bad.sum()) / total, each.max(), each.min(), bad.sum() / total, 1 / (1 + np.log1p(total))]


def _spread(x: np.ndarray) -> np.ndarray:
    """The features, their squares and their products with the difference: what the logistic model weighs."""
    return np.hstack([x, x[:, 1:] ** 2, x[:, 1:2] * x[:, 2:]])


def logistic(x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray | None = None, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method on standardised columns; the first column is the constant."""
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[0] = 0, 1
    scale[scale == 0] = 1
    z = (x - mean) / scale
    w, own = np.zeros(z.shape[1]), np.ones(len(y)) if sample_weight is None else sample_weight
    penalty = np.full(len(w), ridge * own.sum())
    penalty[0] = 1e-9
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (own * (p - y)) + penalty * w
        step = np.linalg.solve((z * (own * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w = w / scale
    w[0] -= (w * mean)[1:].sum()
    return w


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows, calibration = _sample(docs, labels, 0), _sample(docs, labels, 2)
    texts = [[t for label, t in rows if label == k] for k in (1, 0)]
    seen = {label for label, _ in rows + calibration}
    if not all(texts) or len({label for label, _ in calibration}) < 2:
        certain = 1.0 if seen == {1} else 0.0 if seen == {0} else 0.5
        return Model(b"", b"", (), (), (), certain)
    good, bad = map(_train, texts)
    if not good or not bad:
        return Model(b"", b"", (), (), (), 0.5)
    sizes = Sizes(good, bad)
    got = [(label, x) for label, t in calibration if (x := sizes.features(t))]
    x, y = np.array([x for _, x in got]), np.array([label for label, _ in got], dtype=float)
    # The classes were sampled up to the same number; weights bring back their shares among the labelled rows.
    counts = {r["quality"]: r["n"] for r in labels.filter(fold(F.col("doc_id"), FOLDS) == 2).filter("quality in (0, 1)").groupBy("quality").agg(F.count("*").alias("n")).collect()}
    share = np.array([counts[k] / max(1, (y == k).sum()) for k in (0, 1)])
    weight = share[y.astype(int)]
    weight = weight / weight.mean()
    found = logistic(_spread(x), y, weight)
    return Model(good, bad, tuple(found), tuple(x.min(0)), tuple(x.max(0)), counts[1] / (counts[0] + counts[1]))


def score(docs: DataFrame, model: Model) -> Column:
    """The score of ``docs.text`` as a column expression."""

    @F.arrow_udf("double")
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from frees(numbers)(texts)

    def numbers(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sizes = Sizes(model.good, model.bad) if model.weights else None
        weights = np.array(model.weights)
        for batch in texts:
            out = np.full(len(batch), model.empty)
            if sizes:
                got = [(i, x) for i, t in enumerate(x.as_py() for x in batch) if t and (x := sizes.features(t))]
                if got:
                    z = _spread(np.clip(np.array([x for _, x in got]), model.low, model.high)) @ weights
                    out[[i for i, _ in got]] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.array(out)

    return scored(docs["text"])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    model = fit(docs, labels)
    rows = docs.select("doc_id", "text")
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(rows, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, all columns as they are."""
    return docs.filter(score(docs, fit(docs, labels)) >= threshold)
