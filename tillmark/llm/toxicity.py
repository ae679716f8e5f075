"""Toxicity scores by weak supervision.

Voters look at a text: lexicons of words and of word beginnings, and patterns (spelling with digits and signs, letters set
apart, abuse addressed to a reader, several hits). The lexicons hold a fixed list of insults and what labelled
documents show: words and beginnings that stand in toxic documents far more often than chance allows, by a likelihood ratio
that grows with the number of candidates.

A generative label model has for each class the probability that a voter fires. It is fitted by expectation maximisation
on the votes over labelled and unlabelled documents; a known label is one more vote, of accuracy GOLD. Voters that
fire together beyond what the class explains are correlated, and each counts for its share of such a cluster only. A
linear classifier is then trained on the posterior labels, with the votes and hit counts as its features.

Fitting reads at most LABELLED documents of each class and UNLABELLED others (those with the lowest seeded hash of their id),
none of them held out. Scoring reads every text whole.

Cases: a null or empty text has no hits and scores as such. A row with a null label is not learnt from. A null id is never
learnt from and is not held out. Repeated rows score alike. Without labels the fixed list and the patterns vote alone, with
a toxic share of PRIOR. Columns beyond the id and the text are never read. An empty table has no scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.llm.quality import fold, held_out, logistic
from tillmark.llm.words import frees, slices

FOLDS, HELD_OUT = 4, 2
LABELLED, UNLABELLED, SEED = 10_000, 5_000, 23
GOLD, PRIOR, ENTRIES, PREFIXES = 0.98, 0.05, 4000, (4, 5, 6)
#: The share of toxic documents among the labelled ones that have an entry of a lexicon.
PURE = 0.8

# Insults that vote without any label.
INSULTS = frozenset(
    """idiot idiots moron morons stupid imbecile dumb dumbass loser losers scum trash worthless pathetic disgusting clown
    jerk bastard bitch asshole shithead fuck fucker fucking retard slut whore pig filth vermin idiota estúpido imbécil
    basura asqueroso payaso cabrón puta idioten dummkopf arschloch abschaum hurensohn schlampe versager idiote crétin
    connard salope ordure raclure minable abruti""".split()
)
# Signs that stand for letters.
SIGNS = str.maketrans("013457@$!", "oieastasi")
WORD = re.compile(r"[^\W\d_]+")
SIGNED = re.compile(r"[^\W_]*[013457@$!][\w@$!]*[^\W\d_][\w@$!]*|[^\W\d_][\w@$!]*[013457@$!][\w@$!]*")
APART = re.compile(r"(?<!\w)[^\W\d_](?:[ .*_-][^\W\d_]){3,}(?!\w)")
ADDRESSED = re.compile(r"\b(?:you|your|u|du|ihr|tu|vous|tú|eres|usted)\b(?:\W+\w+){0,3}?\W+([^\W\d_]+)")

#: Parts of a learnt lexicon that vote apart, from the surest entries to the least sure.
SHARES = 3
VOTERS = [
    *(f"words {i}" for i in range(SHARES)),
    *(f"beginnings of {n}, {i}" for n in PREFIXES for i in range(SHARES)),
    "insults",
    "signs for letters",
    "letters apart",
    "addressed",
    "several hits",
]


@dataclass(frozen=True)
class Lexicon:
    """Learnt entries and the share of the lexicon that each is in; beginnings by length."""

    words: dict[str, int]
    beginnings: dict[int, dict[str, int]]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: tuple[float, ...]


def tokens(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def hits(text: str, lexicon: Lexicon) -> list[int]:
    """How many distinct words of the text make each voter fire, in the order of VOTERS."""
    out = [0] * len(VOTERS)
    words = tokens(text)
    found = set()
    for w in words & lexicon.words.keys():
        out[lexicon.words[w]] += 1
        found.add(w)
    at = SHARES
    for n in PREFIXES:
        known = lexicon.beginnings[n]
        if known:
            for w in words:
                share = known.get(w[:n])
                if share is not None and len(w) >= n:
                    out[at + share] += 1
                    found.add(w)
        at += SHARES
    out[at] = len(words & INSULTS)
    bad = lambda w: w in INSULTS or w in lexicon.words
    out[at + 1] = sum(bad(m.lower().translate(SIGNS)) for m in set(SIGNED.findall(text)))
    out[at + 2] = sum(bad(re.sub(r"[\W_]", "", m.lower())) for m in set(APART.findall(text)))
    if found or out[at]:
        out[at + 3] = sum(bad(m.lower()) for m in set(ADDRESSED.findall(text.lower())))
    several = len(found | (words & INSULTS))
    out[at + 4] = several if several > 1 else 0
    return out


def _lowest(rows: DataFrame, n: int) -> list:
    ids = rows.select("doc_id").where("doc_id is not null").distinct()
    return [r[0] for r in ids.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(n).collect()]


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, label (-1: unknown) and text of the documents to fit on. Their number bounds the broadcast."""
    learnt = labels.filter((fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("toxic").isin(0, 1))
    chosen = {i: -1 for i in _lowest(docs.filter(fold(F.col("doc_id"), FOLDS) != HELD_OUT), UNLABELLED)}
    for label in (0, 1):
        chosen |= {i: label for i in _lowest(learnt.filter(F.col("toxic") == label), LABELLED)}
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    wanted = F.broadcast(spark.createDataFrame(list(chosen.items()), f"doc_id {kind}, label int"))
    return docs.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "label", F.coalesce("text", F.lit("")).alias("text"))


def _counts(sample: DataFrame) -> DataFrame:
    """n (0: word, else beginning of n characters), token, toxic, clean: labelled documents that have it. Counted by batch
    before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            counts = (Counter(), Counter())
            for label, text in zip(batch.column("label").to_pylist(), texts, strict=True):
                words = tokens(text)
                counts[label].update((0, w) for w in words)
                for n in PREFIXES:
                    counts[label].update({(n, w[:n]) for w in words if len(w) >= n})
            keys = list(counts[1].keys() | counts[0].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts[::-1])],
                names=["n", "token", "toxic", "clean"],
            )

    rows = sample.filter("label >= 0").select("doc_id", "label", "text").mapInArrow(frees(run), "n int, token string, toxic long, clean long")
    return rows.groupBy("n", "token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_lexicon(sample: DataFrame, toxic: int, clean: int) -> Lexicon:
    empty = Lexicon({}, {n: {} for n in PREFIXES})
    if not toxic or not clean:
        return empty
    counts = _counts(sample).filter("toxic >= 2")
    base = toxic / (toxic + clean)
    both = F.col("toxic") + F.col("clean")
    part = lambda k, share: F.when(k > 0, 2 * k * F.log(k / (both * share))).otherwise(0.0)
    ratio = part(F.col("toxic"), base) + part(F.col("clean"), 1 - base)
    scored = counts.filter(F.col("toxic") / both >= PURE).withColumn("ratio", ratio)
    candidates = counts.count()
    best = scored.filter(F.col("ratio") > 2 * np.log(max(candidates, 50))).orderBy(F.col("ratio").desc(), "n", "token").limit(ENTRIES).collect()
    for n in (0, *PREFIXES):
        ranked = [r["token"] for r in best if r["n"] == n]
        own = empty.beginnings[n] if n else empty.words
        own |= {token: i * SHARES // len(ranked) for i, token in enumerate(ranked)}
    return empty


def label_model(fires: np.ndarray, labels: np.ndarray, prior: float, rounds: int = 25, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of the toxic class for each row, voters' probabilities to fire by class, and their weights.

    ``labels`` are 0, 1 or -1 for unknown. ``number`` says how many documents each row stands for, one by default. A voter's weight is one over the size of its cluster: one plus the positive
    correlations with other voters that the class does not explain.
    """
    gold = np.where(labels == 1, 1.0, np.where(labels == 0, -1.0, 0.0)) * np.log(GOLD / (1 - GOLD))
    weight = np.ones(fires.shape[1])
    number = np.ones(len(fires)) if number is None else number
    q = np.where(labels >= 0, labels, np.where(fires.any(1), 0.5, prior / 2)).astype(float)
    theta = np.zeros((2, fires.shape[1]))
    for _ in range(rounds):
        for y, own in ((0, number * (1 - q)), (1, number * q)):
            theta[y] = (own @ fires + (0.2 if y else 0.02)) / (own.sum() + 1)
        theta = np.clip(theta, 1e-5, 1 - 1e-5)
        rest = [fires - theta[y] for y in (0, 1)]
        inside = sum((r * own[:, None]).T @ r for r, own in zip(rest, (number * (1 - q), number * q), strict=True))
        scale = np.sqrt(np.maximum(np.diag(inside), 1e-12))
        together = inside / np.outer(scale, scale)
        np.fill_diagonal(together, 0)
        weight = 1 / (1 + np.maximum(together - 0.05, 0).sum(1))
        evidence = fires @ (weight * np.log(theta[1] / theta[0])) + (1 - fires) @ (weight * np.log((1 - theta[1]) / (1 - theta[0])))
        q = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + evidence + gold, -30, 30)))
    return q, theta, weight


def features(counts: np.ndarray) -> np.ndarray:
    """A constant, each voter's vote, each voter's hits (damped) and whether any voter fired."""
    fired = counts > 0
    return np.hstack([np.ones((len(counts), 1)), fired, np.log1p(counts), fired.any(1, keepdims=True)]).astype(float)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = _sample(docs, labels)
    learnt = labels.filter((fold(F.col("doc_id"), FOLDS) != HELD_OUT) & F.col("toxic").isin(0, 1))
    totals = {r["toxic"]: r["n"] for r in learnt.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = (min(totals.get(k, 0), LABELLED) for k in (1, 0))
    lexicon = learn_lexicon(sample, toxic, clean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([hits(t, lexicon) for t in texts], pa.list_(pa.int32()))], names=["label", "hits"])

    # Equal rows of votes are one row with its number; their kinds, not the documents, reach the driver.
    voted = sample.select("doc_id", "label", "text").mapInArrow(frees(run), "label int, hits array<int>")
    rows = voted.groupBy("label", "hits").agg(F.count("*").alias("n")).orderBy("label", "hits").collect()
    if not rows:
        return Model(lexicon, tuple(np.zeros(2 * len(VOTERS) + 2)))
    counts, known = np.array([r["hits"] for r in rows], float), np.array([r["label"] for r in rows])
    number = np.array([r["n"] for r in rows], float)
    prior = totals[1] / (totals[0] + totals[1]) if totals.get(0) and totals.get(1) else PRIOR
    # Classes were sampled up to the same number; this brings back their shares.
    share = {1: totals.get(1, 0) / max(toxic, 1), 0: totals.get(0, 0) / max(clean, 1), -1: 1.0}
    number = number * np.array([share[k] for k in known.tolist()])
    q, _, _ = label_model((counts > 0).astype(float), known, prior, number=number)
    return Model(lexicon, tuple(logistic(features(counts), q, number / number.mean(), ridge=2e-4)))


def score(docs: DataFrame, model: Model) -> Column:
    """The score of ``docs.text`` as a column expression."""

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = np.array(model.weights)
        for batch in texts:
            counts = np.array([hits(t or "", model.lexicon) for t in batch], float).reshape(-1, len(VOTERS))
            yield pd.Series(1 / (1 + np.exp(-np.clip(features(counts) @ weights, -30, 30))))

    return scored(docs["text"])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    model = fit(docs, labels)
    rows = docs.select("doc_id", "text")
    scored = rows.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), score(rows, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
