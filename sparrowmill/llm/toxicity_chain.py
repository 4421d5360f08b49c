"""Operator 7: toxicity by classifier chains.

The categories are predicted one after the other by logistic models; each later model also gets the earlier categories'
probabilities. It is trained on out-of-fold ones (each labelled document's come from models that didn't see it), as it
will meet probabilities for unseen documents later on. A text's other features are the words it holds, out of those that
tell labelled documents apart (by chi squared against any category).

With the driver's labels the chain is low_quality (quality 0), then toxic. A document is rejected if its probability of
the last category reaches REJECT. Models are fitted on at most TRAIN_ROWS labelled documents, those of smallest hash, each
as the distinct words of its whole text; FEATURES words at most are a model's vocabulary. These two bounds make the model
and the training task's input independent of the corpus. Prediction reads whole texts.

Defined cases: null and empty texts have no words; their probabilities are the models' base rates. Null labels are left
out of that category's training; a category with labels of one value only always has probability 0 for the other. With no
labelled document all probabilities are 0. Repeated labels of a document count once, as the largest. Repeated rows get
equal predictions, and an empty table none. Kept columns of a result's name give way to it; `reject` keeps all columns.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

TRAIN_ROWS = 6000
FEATURES = 400
CHI_SQUARED = 20.0
FOLDS = 5
RIDGE = 0.3
REJECT = 0.5
CATEGORIES = ("low_quality", "toxic")

_WORDS = re.compile(r"\w+").findall


def words(text: str) -> set[str]:
    return set(_WORDS(text.lower()))


def fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton's method, the constant last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def chance(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def train(held: list[list[str]], labels: np.ndarray) -> dict:
    """The chain for labels (documents by categories, nan: unknown), given each document's words in a fixed order."""
    numbers: dict[str, int] = {}
    rows = [np.array([numbers.setdefault(w, len(numbers)) for w in found], np.int32) for found in held]
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    known = ~np.isnan(labels)
    k = labels.shape[1]
    best = np.zeros(len(numbers))
    for j in range(k):
        # of the documents with a label: how many hold the word, and how many of these are bad
        m = np.bincount(flat, known[doc, j], len(numbers))
        a = np.bincount(flat, np.where(known, labels, 0)[doc, j], len(numbers))
        n, bad = known[:, j].sum(), labels[known[:, j], j].sum()
        if 0 < bad < n:
            usual = (m >= 3) & (m < n)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = n * (a * n - m * bad) ** 2 / (m * (n - m) * bad * (n - bad))
            best = np.maximum(best, np.where(usual, score, 0.0))
    kept = sorted((-best[i], word) for word, i in numbers.items() if best[i] >= CHI_SQUARED)
    vocabulary = {word: i for i, (_, word) in enumerate(kept[:FEATURES])}
    place = np.full(len(numbers), -1)
    for word, i in vocabulary.items():
        place[numbers[word]] = i
    x = np.zeros((len(rows), len(vocabulary)))
    held_ = place[flat] >= 0
    x[doc[held_], place[flat[held_]]] = 1
    fold = np.arange(len(held)) % FOLDS
    models = []
    for j in range(k):
        some = known[:, j]
        y = labels[:, j]
        if len(np.unique(y[some])) < 2:
            models.append(None)
            column = np.full(len(held), float(y[some].mean()) if some.any() else 0.0)
        else:
            models.append(fit_logistic(x[some], y[some]))
            column = np.zeros(len(held))
            for f in range(FOLDS):
                inside = some & (fold != f)
                w = fit_logistic(x[inside], y[inside]) if len(np.unique(y[inside])) == 2 else models[-1]
                column[fold == f] = chance(x[fold == f], w)
        x = np.hstack([x, column[:, None]])
    bases = [float(labels[known[:, j], j].mean()) if known[:, j].any() else 0.0 for j in range(k)]
    return {"vocabulary": vocabulary, "models": models, "bases": bases}


def predict(model: dict, texts: list[str]) -> np.ndarray:
    vocabulary = model["vocabulary"]
    x = np.zeros((len(texts), len(vocabulary)))
    for i, text in enumerate(texts):
        for word in words(text) & vocabulary.keys():
            x[i, vocabulary[word]] = 1
    for w, base in zip(model["models"], model["bases"]):
        column = np.full(len(texts), base) if w is None else chance(x, w)
        x = np.hstack([x, column[:, None]])
    return x[:, len(vocabulary) :]


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """The chain fitted on documents that `labels` covers: its category columns by CATEGORIES' order are derived here."""
    labels = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 0).cast("double")).alias("c0"), F.max((F.col("toxic") == 1).cast("double")).alias("c1"))
    sample = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    runtime.small_batches(docs.sparkSession)
    rows = docs.select("doc_id", runtime.text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")  # TRAIN_ROWS ids at most

    def held(batches):
        for batch in batches:
            found = [sorted(words(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), *batch.columns[2:]], names=["doc_id", "words", "c0", "c1"])

    def run(batches):
        rows: dict = {}
        for batch in batches:
            for doc, found, *marks in zip(*(c.to_pylist() for c in batch.columns)):
                # of several texts of one doc_id the first in order counts
                if doc not in rows or found < rows[doc][0]:
                    rows[doc] = found, marks
        if rows:
            order = np.random.default_rng(7).permutation(len(rows))
            every = sorted(rows)
            ids = [every[i] for i in order]
            marks = np.array([[np.nan if m is None else m for m in rows[i][1]] for i in ids], float)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([rows[i][0] for i in ids], marks))], pa.binary())], names=["model"])

    # the bounded sample meets in one task
    found = rows.mapInArrow(held, "doc_id long, words array<string>, c0 double, c1 double").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(found[0][0])) if found else {"vocabulary": {}, "models": [None, None], "bases": [0.0, 0.0]}


PREDICTED = "p_low_quality double, p_toxic double, rejected boolean"


def score(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """The columns `keep` and the chain's probabilities for each text."""
    runtime.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES words and weights at most
    keep, kept = runtime.kept(docs, keep, PREDICTED)

    def run(batches):
        for batch in batches:
            got = predict(shared.value, [x or "" for x in batch.column(batch.num_columns - 1).to_pylist()])
            p = np.round(got, 6)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 1] >= REJECT)], names=[*keep, "p_low_quality", "p_toxic", "rejected"])

    return docs.select(*keep, F.col("text").alias("_text_to_score")).mapInArrow(run, f"{kept}{PREDICTED}")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the chain doesn't reject."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")
    return score(rows, fit(docs, labels), ["row"]).where("NOT rejected").select("row.*")


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = runtime.documents(spark, sf_dir)
    return score(docs, fit(docs, runtime.read_table(spark, sf_dir, "labels")), ["doc_id"])
