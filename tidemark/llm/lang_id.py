"""Language ID as inference over a mixture of languages.

Method (after Lui, Lau and Baldwin, 2014): a document is a bag of byte n-grams (1 to 3 bytes
of the lower-cased letters with word boundaries), each drawn from one of the document's
languages. Each language has a smoothed multinomial over hashed n-grams, learned from
labelled documents. For a set of languages, expectation-maximisation estimates the
proportions that maximise the likelihood of the document's n-grams; languages join the set
one by one while the penalised likelihood (BIC: half a logarithm of the n-gram count for each
further language) improves. The prediction is the language with the largest proportion;
``score`` is that proportion.

The model is learned from the whole texts of about ``per_language`` labelled documents of each
language, chosen by a hash of the id: a documented bound on the sample, not on what is
predicted. Every language is learned, however rare; the model has languages x SLOTS numbers,
broadcast with the task. Every whole text is scored.

Edge cases: a text that is null, empty or without a letter is ``und`` with score 0; without
labelled documents everything is ``und``; null and repeated ids pass through; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import in_parts
from tidemark.llm.common import ship, text_bytes

UNDETERMINED = "und"
SLOTS, PER_LANGUAGE = 1 << 15, 400
STEPS, PENALTY = 30, 0.5
_NOT_LETTERS = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")
_ASCII_LETTER = re.compile(rb"[A-Za-z]").search


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams and their counts: words in lower case, one space between, 1 to 3 bytes."""
    letters = _NOT_LETTERS.sub(b" ", text.decode("utf-8", "replace").lower().encode("utf-8") if not text.isascii() else text.lower())
    x = np.frombuffer(b" " + letters + b" ", np.uint8).astype(np.uint32)
    two = (x[:-1] << np.uint32(8)) | x[1:] | np.uint32(1 << 24)
    three = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:] | np.uint32(1 << 25)
    one = x[x != 32]
    grams = np.concatenate((one, two, three))
    slots = (grams * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)
    if len(slots) > SLOTS:
        counts = np.bincount(slots, minlength=SLOTS)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(slots, return_counts=True)


def mix(weights: np.ndarray, likelihood: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Expectation-maximisation of the proportions; likelihood: languages x n-grams."""
    n = counts.sum()
    for _ in range(steps):
        joint = weights[:, None] * likelihood
        total = joint.sum(axis=0)
        new = joint @ (counts / total) / n
        if np.abs(new - weights).max() < 1e-4:
            weights = new
            break
        weights = new
    return weights, float(counts @ np.log(weights @ likelihood))


def infer(likelihood: np.ndarray, text: bytes) -> list[tuple[int, float]]:
    """Languages (row of ``likelihood``) with their proportions, the largest first."""
    found, counts = features(text)
    at = likelihood[:, found]
    counts = counts.astype(np.float64)
    alone = np.log(at) @ counts
    chosen, best = [int(alone.argmax())], float(alone.max())
    proportions = np.ones(1)
    penalty = PENALTY * np.log(max(counts.sum(), 2.0))
    order = np.argsort(-alone, kind="stable")
    while len(chosen) < len(at):
        # the gradient of the likelihood at a small share of each further language: the most useful one is tried
        now = proportions @ at[chosen]
        gain = at @ (counts / now)
        rest = [k for k in order.tolist() if k not in chosen]
        k = max(rest, key=lambda i: gain[i])
        if gain[k] <= counts.sum():
            break  # no share of any further language raises the likelihood, as it is concave
        start = np.concatenate((proportions * 0.8, [0.2]))
        tried, value = mix(start, at[[*chosen, k]], counts)
        if value - best <= penalty:
            break
        chosen, proportions, best = [*chosen, k], tried, value
    return sorted(zip(chosen, proportions.tolist(), strict=True), key=lambda x: (-x[1], x[0]))


class Model:
    def __init__(self, languages: list[str], likelihood: np.ndarray):
        self.languages, self.likelihood = languages, likelihood

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not self.languages or not text or not has_letter(text):
            return UNDETERMINED, 0.0
        language, share = infer(self.likelihood, text)[0]
        return self.languages[language], float(min(1.0, max(0.0, share)))


def fit(
    spark: SparkSession,
    labelled: DataFrame,
    per_language: int = PER_LANGUAGE,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> Model:
    """Learns from rows with a language; the sample is bounded as the module says."""
    ship(spark)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("string"), F.lit("lang-sample")).alias("h"), F.col(text_col).alias("t")
    )
    # a threshold on the hash keeps about the wanted number of each language without a sort of it
    many = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > per_language)
    bar = F.coalesce(F.lit(float(per_language)) / F.col("n"), F.lit(1.0))
    span = float(1 << 63)
    sample = rows.join(F.broadcast(many), "lang", "left").where((F.col("h").cast("double") / (2 * span) + 0.5) <= bar).select("lang", F.col("t").cast("binary").alias("t"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in in_parts(batches):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if has_letter(text):
                    found, counts = features(text)
                    sums.setdefault(lang, np.zeros(SLOTS, np.int64))[found] += counts
        for lang, total in sums.items():
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["lang", "slot", "n"])

    # at most languages x SLOTS rows reach the driver, as columns
    summed = sample.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    rows_of = summed.column("lang").to_pandas()
    languages = sorted(rows_of.unique().tolist())
    table = np.zeros((len(languages), SLOTS))
    if not languages:
        return Model([], table)
    table[rows_of.map({x: k for k, x in enumerate(languages)}).to_numpy(np.int64), summed.column("slot").to_numpy()] = summed.column("n").to_numpy()
    table += 0.5
    return Model(languages, table / table.sum(axis=1, keepdims=True))


def predict(spark: SparkSession, docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """doc_id, lang_pred, score and the columns ``keep`` for every row."""
    ship(spark)
    keep = keep or []
    rows = docs.select(text_bytes(text_col).alias("__t"), F.col(id_col).alias("doc_id"), *keep)
    schema = rows.drop("__t").schema.add("lang_pred", "string").add("score", "double")
    shared = spark.sparkContext.broadcast(model)  # languages x SLOTS doubles at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches):
            made = [shared.value.predict(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[1:], pa.array([x[0] for x in made], pa.string()), pa.array([x[1] for x in made], pa.float64())], names=[*b.schema.names[1:], "lang_pred", "score"]
            )

    return rows.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def language_id(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = fit(spark, docs.where(~held_out(id_col)), id_col=id_col, text_col=text_col, lang_col=lang_col)
    return predict(spark, docs, model, id_col, text_col, [held_out(id_col).alias("held_out")]).select("doc_id", "held_out", "lang_pred", "score")
