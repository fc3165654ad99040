"""Toxicity by weak supervision.

1. *Voters.* A short built-in lexicon and a pattern, and words and word starts that labelled
   documents show mostly on one side. Voters vote "toxic" or abstain. Entries of the lexicon that the
   sample shows are judged like all others; only those it never shows have a given weight.
2. *Label model.* A latent label per document, voters with unknown accuracies. EM estimates how
   often each voter fires for either label. Voters that agree more than the label explains are
   correlated (a word and its start, say); their evidence is divided by the size of the correlated
   group, so that it counts about once. The given labels enter as one more voter of unknown accuracy.
3. *Classifier.* A logistic regression on the voters' features and the text's further features is
   trained on the posterior labels of step 2, not on the given ones.

Scoring only reads the text. Fitting reads a sample of at most ``SAMPLE`` labelled rows, picked by
a hash of the id; only counts per feature and the sample's feature lists of the ``FEATURES`` chosen
ones leave the tasks.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import portions, small, stored

# Bounds of the model.
SAMPLE = 20_000
FEATURES = 4_096
VOTERS = 256
LEAST_DOCUMENTS = 3
STEMS = (4, 5, 6)
FOLDS = 5
PIECE = 1 << 20

# Insults that need no labels to be known.
LEXICON = (
    "clown disgusting idiot loser moron pathetic scum stupid trash worthless"
    " dumb dummkopf vollidiot arschloch imbécile connard salaud estúpido imbécil"
).split()
PATTERN = re.compile(r"(?:^|\W)(?:you(?:'re| are) (?:an? )?(?:idiot|moron|clown|loser)|shut up)\b")
WORD = re.compile(r"[^\W\d_]+")
GIVEN_VOTERS = frozenset({f"={word}" for word in LEXICON} | {"~insult"})
# Log-odds of "toxic" of an otherwise unknown text with a lexicon entry that the sample does not show.
UNSEEN_ODDS = 2.0


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: CRC-32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of about a million characters, cut at white space."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


def text_words(text: str) -> set[str]:
    words: set[str] = set()
    for piece in pieces(text):
        words.update(WORD.findall(piece.lower()))
    return words


def word_features(word: str) -> list[str]:
    """A word votes as itself and by its starts, which carry inflected and compound forms."""
    return [f"={word}"] + [f"^{word[:n]}" for n in STEMS if len(word) > n]


def features(text: str) -> set[str]:
    found = {f for word in text_words(text) for f in word_features(word)}
    if any(PATTERN.search(piece.lower()) for piece in pieces(text)):
        found.add("~insult")
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """``(text, toxic)`` of at most ``rows`` labelled documents outside the held-out fold.

    An id counts once: as toxic if any of its labels says so, and with the smallest of its texts in
    the order of their bytes, however often labels and documents repeat it.
    """
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    )
    picked = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    picked = stored(picked, "label-sample")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(small(picked, SAMPLE), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).drop("doc_id")


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches, 64):
        found = [sorted(features(text.as_py())) for text in batch.column(0)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(found, pa.list_(pa.string())), batch.column(1)], names=["found", "toxic"]
        )


def pick_features(sample: DataFrame, most: int = FEATURES) -> list[tuple[str, int, int]]:
    """The features with the strongest tie to a label: (feature, toxic documents, other documents).

    Strength is the log-likelihood gain of knowing the feature; ties go by name. A gain that chance
    gives to one of so many features (below the logarithm of their number) counts as none. Entries of
    the lexicon and the pattern come first, whatever their tie: the label model is to judge them.
    """
    totals = sample.agg(
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.count(F.lit(1)).alias("rows")
    )
    counts = (
        sample.select(F.explode("found").alias("feature"), "toxic")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("n1"), F.count(F.lit(1)).alias("n"))
        .withColumn("given", F.col("feature").isin(*sorted(GIVEN_VOTERS)))
        .filter(F.col("given") | (F.col("n") >= LEAST_DOCUMENTS))
    )
    known = totals.first()
    if not known.toxic or known.toxic == known.rows:
        return []
    rate = known.toxic / known.rows
    inside = (F.col("n1") + rate) / (F.col("n") + 1)
    gain = F.col("n1") * F.log(inside / rate) + (F.col("n") - F.col("n1")) * F.log(
        (1 - inside) / (1 - rate)
    )
    counts = stored(counts.withColumn("gain", F.round(gain, 9)), "feature-counts")
    strong = counts.filter(F.col("given") | (F.col("gain") >= math.log(max(1, counts.count()))))
    rows = strong.orderBy(F.desc("given"), F.desc("gain"), "feature").limit(most).collect()
    return [(r.feature, r.n1, r.n - r.n1) for r in rows]


@dataclass
class Votes:
    """Which of the picked features each sample document has, as parallel lists of row and column."""

    row: np.ndarray
    column: np.ndarray
    given: np.ndarray
    width: int

    def sums(self, by_document: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=by_document[self.row], minlength=self.width)

    def scores(self, by_feature: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=by_feature[self.column], minlength=len(self.given))

    def only(self, columns: np.ndarray) -> Votes:
        place = np.full(self.width, -1)
        place[columns] = np.arange(len(columns))
        kept = place[self.column] >= 0
        return Votes(self.row[kept], place[self.column[kept]], self.given, len(columns))


def collect_votes(sample: DataFrame, picked: list[str]) -> Votes:
    place = {f: i for i, f in enumerate(picked)}
    names = sample.sparkSession.sparkContext.broadcast(place)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = names.value
        for batch in portions(batches):
            found = [sorted(known[f] for f in row.as_py() if f in known) for row in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["columns", "toxic"]
            )

    rows = sample.select("found", "toxic").mapInArrow(encode, "columns array<int>, toxic int")
    table = rows.toArrow()
    # A fixed order, so that sums of floats are the same in every run.
    listed = sorted(zip(table["columns"].to_pylist(), table["toxic"].to_pylist(), strict=True))
    lengths = [len(c) for c, _ in listed]
    return Votes(
        np.repeat(np.arange(len(listed)), lengths),
        np.array([x for c, _ in listed for x in c], dtype=np.int64),
        np.array([y for _, y in listed], dtype=np.float64),
        len(picked),
    )


def correlated_groups(votes: Votes, posterior: np.ndarray, least: float = 0.2) -> np.ndarray:
    """For each voter, how many voters say much the same given the label, itself included.

    The correlation of two voters' residuals (vote minus what the label explains) beyond ``least``
    counts with its size.
    """
    documents = len(posterior)
    dense = np.zeros((documents, votes.width), dtype=np.float32)
    dense[votes.row, votes.column] = 1
    p1 = (votes.sums(posterior) + 1) / (posterior.sum() + 2)
    p0 = (votes.sums(1 - posterior) + 1) / ((1 - posterior).sum() + 2)
    dense -= (posterior[:, None] * p1 + (1 - posterior)[:, None] * p0).astype(np.float32)
    cover = dense.T @ dense / max(1, documents)
    scale = np.sqrt(np.maximum(np.diag(cover), 1e-9))
    tie = np.abs(cover / scale[:, None] / scale[None, :])
    np.fill_diagonal(tie, 1)
    return np.where(tie >= least, tie, 0).sum(axis=1)


def label_model(votes: Votes, prior: float, rounds: int = 20) -> np.ndarray:
    """Posterior probability of "toxic" for each sample document.

    Starts from the given labels, softened; then alternates between the rates of all voters, the
    given label among them, and the posterior. Correlated voters share their weight.
    """
    posterior = np.where(votes.given > 0, 0.9, 0.1 * prior)
    for turn in range(rounds):
        if turn % 5 == 0:  # what looks correlated shrinks as the posterior sharpens
            share = 1 / correlated_groups(votes, posterior)
        mass1, mass0 = posterior.sum(), (1 - posterior).sum()
        fire1 = (votes.sums(posterior) + 0.1) / (mass1 + 1)
        fire0 = (votes.sums(1 - posterior) + 0.1) / (mass0 + 1)
        # Beta priors keep the given labels better than chance and never certain.
        right1 = ((posterior * votes.given).sum() + 9) / (mass1 + 10)
        right0 = (((1 - posterior) * (1 - votes.given)).sum() + 9) / (mass0 + 10)
        evidence = votes.scores(share * np.log(fire1 / fire0))
        silence = votes.scores(share * np.log((1 - fire1) / (1 - fire0)))
        evidence += (share * np.log((1 - fire1) / (1 - fire0))).sum() - silence
        evidence += np.where(
            votes.given > 0, np.log(right1 / (1 - right0)), np.log((1 - right1) / right0)
        )
        rate = min(max(mass1 / len(posterior), 1e-3), 1 - 1e-3)
        posterior = 1 / (1 + np.exp(-np.clip(evidence + np.log(rate / (1 - rate)), -30, 30)))
    return posterior


def fit_classifier(
    votes: Votes, posterior: np.ndarray, penalty: float = 1e-4, rounds: int = 600
) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on the posterior labels.

    Both labels weigh the same in all, so that 0.5 is the cut also where few documents are toxic.
    Gradient steps with AdaGrad scaling.
    """
    mass1 = max(posterior.sum(), 1e-9)
    mass0 = max((1 - posterior).sum(), 1e-9)
    weight, bias = np.zeros(votes.width), 0.0
    size, size0 = np.full(votes.width, 1e-8), 1e-8
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(votes.scores(weight) + bias, -30, 30)))
        error = (1 - posterior) * p / mass0 - posterior * (1 - p) / mass1
        slope = votes.sums(error) + penalty * weight
        slope0 = error.sum()
        size += slope**2
        size0 += slope0**2
        weight -= slope / np.sqrt(size)
        bias -= slope0 / np.sqrt(size0)
    return weight, float(bias)


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def score(self, text: str) -> float:
        """Probability of "toxic"; the bias alone decides over texts without known features."""
        total = self.bias + sum(self.weights.get(f, 0.0) for f in features(text))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, total)))))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE, most: int = FEATURES) -> Model:
    """The model learned from the labels outside the held-out fold.

    Without labelled rows of both kinds, the lexicon alone decides.
    """
    sample = labelled_sample(docs, labels, sample_rows)
    found = stored(
        sample.mapInArrow(_feature_rows, "found array<string>, toxic int"), "features"
    )
    counted = pick_features(found, most)
    if not counted:
        return Model({f: 2 * UNSEEN_ODDS for f in sorted(GIVEN_VOTERS)}, -UNSEEN_ODDS)
    picked = [f for f, _, _ in counted]
    votes = collect_votes(found, picked)
    prior = votes.given.mean()
    # Voters: lexicon and pattern, then features that are more common in toxic documents, strongest first.
    voters = [
        i for i, (f, n1, n0) in enumerate(counted) if f in GIVEN_VOTERS or n1 * (1 - prior) > n0 * prior
    ][:VOTERS]
    posterior = label_model(votes.only(np.array(voters, dtype=np.int64)), prior)
    weight, bias = fit_classifier(votes, posterior)
    weights = {f: round(float(w), 9) for f, w in zip(picked, weight, strict=True)}
    for f in sorted(GIVEN_VOTERS):
        weights.setdefault(f, round(max(0.0, UNSEEN_ODDS - bias), 9))
    return Model(weights, round(bias, 9))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Columns doc_id, score and predicted for every row of ``docs``. Null texts count as empty."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = known.value.score
        for batch in portions(batches):
            found = np.array([scored(text.as_py()) for text in batch.column(1)], dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found), pa.array((found >= 0.5).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(score, f"doc_id {kind}, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> DataFrame:
    """Columns doc_id, held_out, score and predicted for every row of ``docs``.

    Rows without an id belong to the fold of the empty text. Repeated rows get equal scores, reruns
    the same ones. Null texts count as empty; long ones are read whole, piece by piece. Further
    columns are not read. Without labels, the lexicon decides.
    """
    scored = score_documents(docs, fit(docs, labels, sample_rows))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def clean_documents(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that are not predicted to be toxic, with all their columns."""
    known = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample_rows))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = known.value.score
        for batch in portions(batches):
            texts = batch.column("text")
            yield batch.filter(pa.array([scored(t.as_py() or "") < 0.5 for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
