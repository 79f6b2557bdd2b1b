"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import arrow_map, slices, stored, utf8

#: Hashed features; the first is the bias.
BITS = 15
#: Different labelled texts of each language, in expectation, that the classifier is fitted on at most.
SAMPLE_PER_LANGUAGE = 1500
#: Passes over the sample, and parts of it that are trained apart and averaged after each.
PASSES, PARTS = 3, 4
#: Learning rate, its smoothing, and the two penalties of the elastic net.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.002
#: Share of the sample that the temperature is fitted on.
CALIBRATION_PERCENT = 15
_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Features and counts of all runs of one to three characters; None for a text without a letter.

    Letters count in lower case, each other stretch as one space.
    """
    words = " ".join(_WORD.findall(text.lower()))
    if not any(map(str.isalpha, words)):
        return None
    c = np.frombuffer(f" {words} ".encode("utf-32-le", "replace"), np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
    mixed = np.concatenate([c * np.uint32(0x165667B1), two, three])
    mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    counts = np.bincount(mixed >> np.uint32(32 - BITS), minlength=1 << BITS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def tf_idf(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Features, shifted by one, and values of length 1; the bias comes first."""
    found = ngrams(text)
    if found is None:
        return None
    values = (1 + np.log(found[1])) * idf[found[0]]
    values /= math.sqrt(values @ values)
    return np.concatenate([[0], found[0] + 1]), np.concatenate([[1.0], values])


@dataclass
class LanguageModel:
    """What prediction needs; its size does not grow with the corpus."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x features
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray | None:
        found = tf_idf(text, self.idf)
        return None if found is None else self.weights[:, found[0]] @ found[1]


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights of the regularised leader: zero where the evidence stays below the first penalty."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def follow_leader(z: np.ndarray, n: np.ndarray, rows: Iterable[tuple[int, np.ndarray, np.ndarray]]) -> None:
    """One pass over (language, features, values), which updates the state in place."""
    for label, at, values in rows:
        zs, ns = z[:, at], n[:, at]
        w = weights_of(zs, ns)
        p = softmax(w @ values)
        p[label] -= 1
        g = p[:, None] * values
        new = ns + g * g
        z[:, at] = zs + g - (np.sqrt(new) - np.sqrt(ns)) / ALPHA * w
        n[:, at] = new


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss on texts that were not trained on; 1 without any."""
    if not len(labels):
        return 1.0
    loss = lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-300)).mean()
    return float(min(np.geomspace(0.02, 20, 400), key=loss))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts; over all rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = np.zeros(1 << BITS, np.int64), 0
        for batch in slices(batches):
            for data in utf8(batch.column(0)):
                if (found := ngrams(data.decode("utf-8", "replace"))) is not None:
                    seen[found[0]] += 1
                    rows += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int64()), pa.array([*seen[at].tolist(), rows], pa.int64())],
                                         ["feature", "texts"])

    out, total = np.zeros(1 << BITS), 0
    counted = texts.mapInArrow(count, "feature long, texts long").groupBy("feature").agg(F.sum("texts").alias("texts"))
    for r in counted.collect():  # one row for each feature
        if r.feature < 0:
            total = r.texts
        else:
            out[r.feature] = r.texts
    return out, total


def _trainer(z: np.ndarray, n: np.ndarray):
    """One pass over a part of the sample, from the given state."""
    def train(table: pa.Table) -> pa.Table:
        state = z.copy(), n.copy()
        table = table.sort_by([("order", "ascending"), ("label", "ascending")])
        follow_leader(*state, ((label, np.array(at), np.array(v)) for label, at, v in zip(
            *(table.column(c).to_pylist() for c in ("label", "at", "values")))))
        return pa.table([pa.array([s.tobytes()], pa.binary()) for s in state], names=["z", "n"])

    return train


def train_language_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                         per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit the model on labelled rows; rows without text or language, or without a letter, teach nothing.

    Document frequencies cover all labelled rows.  The classifier is fitted on ``per_language`` different texts of
    each language in expectation, drawn by a hash of the text, each once however many rows hold it.  The draws are
    independent, so the number drawn stays within a few of its square roots, whatever is repeated.
    The state is trained in ``PARTS`` fixed parts, averaged after each pass, so the model depends
    neither on the cluster nor on the order of rows.  Its size, languages times features, is what the driver holds.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    seen, total = document_frequencies(rows.select("text"))
    different = rows.groupBy("lang").agg(F.count_distinct(F.xxhash64("text")).alias("texts"))
    counts = {r.lang: r.texts for r in different.collect()}
    languages = sorted(counts)
    idf = np.log((1 + total) / (1 + seen)) + 1
    width = (1 << BITS) + 1
    if not languages:
        return LanguageModel([], idf, np.zeros((0, width)))
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, per_language / counts[k]))])
    drawn = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    number = F.create_map(*[F.lit(x) for i, k in enumerate(languages) for x in (k, i)])
    picked = rows.where(drawn < share[F.col("lang")]).select(
        "text", number[F.col("lang")].alias("label"), F.xxhash64("text", F.lit(1)).alias("order")).dropDuplicates(["label", "order"])
    picked = picked.withColumn("part", F.when(F.pmod("order", F.lit(100)) < CALIBRATION_PERCENT, -1).otherwise(
        F.pmod(F.shiftright("order", 7), F.lit(PARTS))).cast("int"))

    def featurise(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        found = [tf_idf(d.decode("utf-8", "replace"), idf) for d in utf8(batch.column(0))]
        keep = pa.array([f is not None for f in found], pa.bool_())
        found = [f for f in found if f is not None]
        rest = batch.select(["label", "order", "part"]).filter(keep)
        yield pa.RecordBatch.from_arrays(
            [*rest.columns, pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64()))],
            ["label", "order", "part", "at", "values"])

    sample = stored(arrow_map(picked, "label int, order long, part int, at array<int>, values array<double>", featurise), "sample")
    z, n = np.zeros((len(languages), width)), np.zeros((len(languages), width))
    for _ in range(PASSES):
        states = sample.where("part >= 0").groupBy("part").applyInArrow(_trainer(z, n), "z binary, n binary").collect()
        if states:
            z, n = (np.mean([np.frombuffer(s[i]).reshape(len(languages), width) for s in states], axis=0) for i in (0, 1))
    model = LanguageModel(languages, idf, weights_of(z, n))

    def score(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        found = [(model.weights[:, np.array(at)] @ np.array(v)).tolist() for at, v in zip(
            batch.column("at").to_pylist(), batch.column("values").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(found, pa.list_(pa.float64()))], ["label", "logits"])

    held = arrow_map(sample.where("part < 0"), "label int, logits array<double>", score).collect()  # a share of the bounded sample
    held.sort()
    model.temperature = calibrate(np.array([r.logits for r in held]), np.array([r.label for r in held], int))
    return model


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text",
                     keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row with ``lang_pred`` and ``score``, its calibrated probability.

    The whole text counts, nothing else does.  A text that is null or has no letter is ``und`` with score 0, as is every
    text if no language was learned.  Equal scores go to the first language in order.  Repeated rows are predicted each.
    """
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    weights = model.weights.astype(np.float32)
    small = LanguageModel(model.languages, model.idf, weights, model.temperature)

    def predict(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
        names, scores = [], []
        for data in utf8(batch.column(len(keep))):
            logits = small.logits(data.decode("utf-8", "replace")) if small.languages else None
            if logits is None:
                names.append(UNKNOWN), scores.append(0.0)
            else:
                p = softmax(logits / small.temperature)
                names.append(small.languages[int(p.argmax())]), scores.append(float(p.max()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                         [*keep, "lang_pred", "score"])

    return arrow_map(docs.select(*keep, F.col(text_col)), f"{fields}, lang_pred string, score double", predict)
