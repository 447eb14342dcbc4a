"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased text are hashed to FEATURES columns; document frequencies are counted over
all documents that may teach. The weights are learned on a bounded sample with the follow-the-regularised-leader
(FTRL-proximal) rule and elastic-net penalties, and a temperature, fitted on a part of the sample that taught no
weights, makes the probabilities honest. Prediction sees nothing but the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .staging import Stage, clean, unused

FEATURES = 1 << 15
#: Documents that teach, about: the bound of the sample, split evenly over the languages; but EACH for every language.
SAMPLE, EACH = 6000, 8
#: Bytes of the sample's features that the driver holds; beyond it only each language's first document is added.
SAMPLE_BYTES = 256 << 20
#: Beyond that many languages the state has half the precision, and the model keeps only the weights that are not zero.
DENSE = 64
CALIBRATION = 5  # every fifth document of the sample calibrates
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.5, 0.1
UNDETERMINED = "und"
U = np.uint64
_MULT = tk.mix(np.arange(3, dtype=U), 91) | U(1)


STEP = 1 << 20  # characters whose n-grams are made at a time


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Columns and counts of a text's character n-grams; white space runs count as one blank. Long texts go by steps."""
    text = " " + " ".join(text.lower().split()) + " "
    counts = np.zeros(FEATURES, np.int64)
    for a in range(0, len(text), STEP):
        chars = np.frombuffer(text[a : a + STEP + 2].encode("utf-32-le", "replace"), np.uint32).astype(U)
        total = np.zeros(len(chars), U)
        for k in range(min(3, len(chars))):
            total = total[: len(chars) - k] + (chars[k:] + U(1)) * _MULT[k]
            h = total ^ (total >> U(29))
            # those that begin beyond the step belong to the next one
            counts += np.bincount(((h[:STEP] * U(0xBF58476D1CE4E5B9)) >> U(64 - 15)).astype(np.int32), minlength=FEATURES)
    columns = np.flatnonzero(counts)
    return columns, counts[columns]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(FEATURES, np.int64), 0
    for batch in (p for b in batches for p in tk.parts(b)):
        for text in batch.column("text").to_pylist():
            if has_letter(text):
                df[grams(text)[0]] += 1
                n += 1
    if n:
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["feature", "df"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (p for b in batches for p in tk.parts(b)):
        keep = [i for i, t in enumerate(batch.column("text").to_pylist()) if has_letter(t)]
        batch = batch.take(pa.array(keep, pa.int32()))
        found = [grams(t) for t in batch.column("text").to_pylist()]
        if found:
            yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("lang"), batch.column("first"), pa.array([x[0].astype("<u2").tobytes() for x in found], pa.binary()), pa.array([x[1].astype("<u4").tobytes() for x in found], pa.binary())], ["draw", "lang", "first", "columns", "counts"])


def weigh(columns: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[columns]
    return x / max(1e-12, float(np.sqrt((x * x).sum())))


class Sparse:
    """Weights (columns x languages) without the zeros that L1 leaves."""

    def __init__(self, weights: np.ndarray):
        row, self.at = np.nonzero(weights)
        self.values, self.shape = weights[row, self.at], weights.shape
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(weights)))])

    def dot(self, columns: np.ndarray, x: np.ndarray) -> np.ndarray:
        sizes = self.begin[columns + 1] - self.begin[columns]
        places = np.repeat(self.begin[columns] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return np.bincount(self.at[places], self.values[places] * np.repeat(x, sizes), self.shape[1])


class Model:
    """languages, idf of each column, weights (columns x languages), temperature."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.languages, self.idf, self.temperature = languages, idf, temperature
        self.weights = weights if len(languages) <= DENSE else Sparse(weights)

    def scores(self, text: str) -> np.ndarray:
        columns, counts = grams(text)
        x = weigh(columns, counts, self.idf)
        return self.weights.dot(columns, x) if isinstance(self.weights, Sparse) else x @ self.weights[columns]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        p = softmax(self.scores(text) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_languages: int, epochs: int = EPOCHS, seed: int = 3) -> np.ndarray:
    """FTRL-proximal with per-coordinate rates; L1 keeps the weights sparse. rows: columns, values, language."""
    z, n = (np.zeros((FEATURES, n_languages), float if n_languages <= DENSE else np.float32) for _ in range(2))

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x, y = rows[i]
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    return weights(slice(None))


def calibrate(scores: np.ndarray, truth: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(truth)), truth]).mean())

    if not len(truth):
        return 1.0
    a, b, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(50):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """docs: the documents that may teach (doc_id, text, lang). Rows with a null lang or no letter teach nothing.

    Every language of a document with a letter is learned. doc_id only draws the sample: sample rows about, evenly over
    the languages, EACH of every one at least and the one with the smallest draw always, SAMPLE_BYTES of features at most
    besides these. A language takes a row on the driver, and 256 KB of state while it is learned. Without a row to learn
    from, the model knows no language and every prediction is und.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "language")
    docs = clean(docs, "doc_id", "text", "lang").where("lang IS NOT NULL")
    draw = F.xxhash64("doc_id", F.lit(23))
    some = F.col("text").rlike("\\p{L}")  # its lowest draw may have no letter otherwise
    sizes = stage.put(docs.groupBy(F.col("lang").alias("of")).agg(F.count("*").alias("c"), F.min(F.when(some, draw)).alias("low")), "sizes")
    n_languages = sizes.count()
    if not n_languages:
        return Model([], np.zeros(FEATURES), np.zeros((FEATURES, 0)), 1.0)
    each = max(EACH, sample // n_languages)
    shares = sizes.select("of", "low", F.least(F.lit(1.0), 1.2 * each / F.col("c")).alias("share"))
    df = stage.put(docs.select("text").mapInArrow(tk.task(_document_frequency), "feature long, df long").groupBy("feature").agg(F.sum("df").alias("df")), "df")
    found = {r[0]: r[1] for r in df.collect()}  # FEATURES rows and one at most
    n = found.pop(-1, 0)
    counts = np.zeros(FEATURES)
    counts[list(found)] = list(found.values())
    idf = np.log((1 + n) / (1 + counts)) + 1
    picked = docs.join(stage.small(stage.put(shares, "shares")), F.col("lang") == F.col("of")).where((draw / F.lit(2.0**64) + 0.5 <= F.col("share")) | (draw == F.col("low")))
    picked = picked.select(draw.alias("draw"), "lang", (draw == F.col("low")).alias("first"), "text")
    made_of = stage.put(picked.mapInArrow(tk.task(_features), "draw long, lang string, first boolean, columns binary, counts binary"), "sample")
    taken, held_bytes = [], 0
    for r in made_of.orderBy(F.desc("first"), "draw", "lang").limit(2 * max(sample, EACH * n_languages)).toLocalIterator():
        if not r["first"] and held_bytes > SAMPLE_BYTES:
            break
        held_bytes += len(r["columns"]) + len(r["counts"])
        taken.append(r)
    rows = sorted(taken, key=lambda r: (r["draw"], r["lang"]))
    stage.drop(df)
    languages = sorted({r["lang"] for r in rows})
    at = {lang: k for k, lang in enumerate(languages)}
    made = []
    for r in rows:
        columns = np.frombuffer(r["columns"], "<u2").astype(np.int32)
        made.append((columns, weigh(columns, np.frombuffer(r["counts"], "<u4"), idf).astype(np.float32), at[r["lang"]]))
    # a language with few rows needs them all to be taught
    enough = np.bincount([y for _, _, y in made], minlength=len(languages)) >= CALIBRATION
    calibrates = [len(made) >= 2 * CALIBRATION and i % CALIBRATION == 0 and bool(enough[y]) for i, (_, _, y) in enumerate(made)]
    held = [x for x, c in zip(made, calibrates, strict=True) if c]
    taught = [x for x, c in zip(made, calibrates, strict=True) if not c]
    weights = ftrl(taught, len(languages))
    scores = np.array([x @ weights[c] for c, x, _ in held]).reshape(len(held), len(languages))
    return Model(languages, idf, weights, calibrate(scores, np.array([y for _, _, y in held], int)))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with __lang_pred and __lang_score (with more underscores, if docs has such names). A null text or one without
    a letter is und, with score 0."""
    added = unused(docs, "lang_pred", "lang_score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x DENSE numbers at most, or those that are not zero

    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias("text" if c == "text" else f"__c{i}") for i, c in enumerate(names)])
    schema = T.StructType([*plain.schema.fields, T.StructField("__lang_pred", T.StringType()), T.StructField("__lang_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in (p for b in batches for p in tk.parts(b)):
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            arrays = [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "__lang_pred", "__lang_score"])

    return plain.mapInArrow(tk.task(run), schema).toDF(*names, *added)


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def recognised(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """docs of which the language is recognised, with the same columns: und and scores below least go."""
    model = train(docs.where(~held_out()))
    out = predict(docs, model)
    lang, score = out.columns[-2:]
    return out.where((F.col(lang) != UNDETERMINED) & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = predict(docs.select("doc_id", "text"), train(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__lang_score").alias("score"))
