"""Language identification with string kernels: Nyström landmarks and one-versus-rest kernel ridge regression.

The kernel is the blended-spectrum presence kernel over letters: two texts share as many
features as they have n-grams of 1 to ``ORDER`` letters in common, however often each occurs,
divided by the geometric mean of their own counts.  N-grams are addressed by hash in ``SLOTS``
slots; a slot is present or not.

Learning uses at most ``ROWS_PER_LANG`` rows of each language, those with the smallest id hash,
held-out documents excepted; executors turn their whole texts into presence bits, so what
reaches the driver has a fixed size a row.  ``LANDMARKS`` of these rows span the Nyström map; the
regression has a closed form.  Scoring multiplies batches of presence rows with the landmarks'
and the result with the weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from benchloom.llm.common import held, held_out, pick

ORDER = 3
SLOTS = 1 << 16
ROWS_PER_LANG = 600
LANDMARKS = 128
PARTS = 64  # in which a language's rows are ranked before its best are ranked together
RIDGE = 1e-2
BATCH = 32
LETTERS = 1 << 16  # letters handled at a time
CHANCE_PAIRS = 5.0
POOR = 16
POOR_FROM = 400
RECUR = 2.5  # times chance, from which a text is one of a language
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def presence(text: str | None) -> np.ndarray | None:
    """The slots of the text's n-grams as a boolean row; None if it has no letter."""
    letters = _OTHER.sub(" ", (text or "").lower()).strip()
    if not letters:
        return None
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.zeros(SLOTS, bool)
    for begin in range(0, len(codes), LETTERS):
        part = codes[begin : begin + LETTERS + ORDER - 1].astype(np.uint64)
        gram = np.zeros(len(part), np.uint64)
        for n in range(1, ORDER + 1):
            if len(part) < n:
                break
            gram = gram[: len(part) - n + 1] * np.uint64(0x110000) + part[n - 1 :]
            row[((gram + np.uint64(n)) * _ODD) >> np.uint64(48)] = True
    return row


@dataclass
class Model:
    """Languages, landmark rows (bits packed), weights from landmark kernels to languages, and the score from which a text is in one of them."""

    langs: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    floor: float = 0.0


def babble(text: str | None) -> bool:
    """True for a text whose n-grams of ``ORDER`` letters recur no more than those of letters drawn one by one, each as often as it is there.

    In a language, known or not, they recur far more.  A text in which chance alone gives fewer
    than ``CHANCE_PAIRS`` recurring pairs (a short one, or one of very many letters) can't be told
    from a language and is no babble.  A few syllables over and over are: ``POOR`` times their
    distinct n-grams are fewer than the text's, of which ``POOR_FROM`` count at most.
    """
    letters = _OTHER.sub(" ", (text or "").lower()).strip()
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - ORDER + 1
    if not letters or n < 2:
        return False
    gram = codes[:n].copy()
    for k in range(1, ORDER):
        gram = gram * np.uint64(0x110000) + codes[k : k + n]
    count = np.unique(gram, return_counts=True)[1].astype(np.float64)
    if POOR * len(count) < min(n, POOR_FROM):
        return True
    often = np.unique(codes, return_counts=True)[1] / len(codes)
    chance = n * (n - 1) / 2 * float((often**2).sum()) ** ORDER
    if chance < CHANCE_PAIRS:
        return False
    return float((count * (count - 1) / 2).sum()) < RECUR * chance


def has_letter(text: str | None) -> bool:
    return bool(_OTHER.sub("", text or ""))


def _shares(values: np.ndarray) -> np.ndarray:
    """Regression values as shares of the languages, one row a text."""
    share = np.clip((values + 1) / 2, 1e-6, None)
    return share / share.sum(1, keepdims=True)


class Scorer:
    def __init__(self, model: Model):
        self.langs, self.weights = np.array(model.langs, object), model.weights
        self.rows = np.unpackbits(model.landmarks, axis=1).astype(np.float32)
        self.sizes = np.sqrt(self.rows.sum(1))

    def kernels(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float32)
        return (x @ self.rows.T) / (np.sqrt(x.sum(1))[:, None] * self.sizes)

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not len(self.langs):
            return langs, scores
        for begin in range(0, len(texts), BATCH):
            rows = [(k, r) for k in range(begin, min(begin + BATCH, len(texts))) if (r := presence(texts[k].as_py())) is not None]
            if not rows:
                continue
            share = _shares(self.kernels(np.stack([r for _, r in rows])) @ self.weights)
            best = share.argmax(1)
            for (k, _), b, s in zip(rows, best, share, strict=True):
                langs[k], scores[k] = self.langs[b], float(s[b])
        return langs, scores


def learn(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG, landmarks: int = LANDMARKS) -> Model:
    """The model from (doc_id, text, lang) outside the held-out fifth; null ids, langs and letterless texts teach nothing.

    Its ``floor`` lies halfway between the score of a text that is like no language more than
    another and the least score of the rows learned from; with fewer than two languages it is 0.
    """
    rows = pick(docs, doc_id="bigint", lang="string").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.select("doc_id", "lang").distinct().withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PARTS)))
    for keys in (("lang", "part"), ("lang",)):  # the first of each part hold the first of all
        place = F.row_number().over(W.partitionBy(*keys).orderBy(F.xxhash64("doc_id"), "doc_id"))
        rows = rows.withColumn("n", place).filter(F.col("n") <= rows_per_lang).drop("n")
    chosen = rows.select(F.col("doc_id").alias("i"), F.col("lang").alias("l"))  # rows_per_lang a language

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [presence(t.as_py()) for t in batch.column(2)]
            packed = pa.array([None if r is None else np.packbits(r).tobytes() for r in found], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), packed], names=["doc_id", "lang", "bits"])

    texts = pick(docs, doc_id="bigint", lang="string", text="string").filter("lang is not null")
    texts = texts.join(F.broadcast(chosen), (F.col("doc_id") == F.col("i")) & (F.col("lang") == F.col("l"))).select("doc_id", "lang", "text")
    found = texts.mapInArrow(bits, "doc_id bigint, lang string, bits binary").filter("bits is not null")
    found = found.groupBy("doc_id", "lang").agg(F.min("bits").alias("bits")).collect()  # an id that repeats in a language teaches once
    found.sort(key=lambda r: (r.lang, r.doc_id, r.bits))
    langs = sorted({r.lang for r in found})
    if not langs:
        return Model([], np.zeros((0, SLOTS // 8), np.uint8), np.zeros((0, 0)))
    packed = np.stack([np.frombuffer(r.bits, np.uint8) for r in found])
    each = max(1, landmarks // len(langs))
    where = {lang: [k for k, r in enumerate(found) if r.lang == lang] for lang in langs}
    picked = [k for lang in langs for k in where[lang][:: max(1, len(where[lang]) // each)][:each]]
    own = Scorer(Model(langs, packed[picked], np.zeros((0, 0))))
    kernel = np.concatenate([own.kernels(np.unpackbits(packed[b : b + BATCH], axis=1)) for b in range(0, len(packed), BATCH)]).astype(np.float64)
    values, vectors = np.linalg.eigh(kernel[picked])
    keep = values > 1e-6 * values[-1]
    nystrom = vectors[:, keep] / np.sqrt(values[keep])
    z = kernel @ nystrom
    lang_no = np.array([langs.index(r.lang) for r in found])
    target = np.where(lang_no[:, None] == np.arange(len(langs)), 1.0, -1.0)
    weigh = (1.0 / np.bincount(lang_no))[lang_no][:, None]  # each language counts alike
    beta = np.linalg.solve(z.T @ (weigh * z) + RIDGE * np.eye(z.shape[1]), z.T @ (weigh * target))
    weights, even = (nystrom @ beta).astype(np.float32), 1 / len(langs)
    least = float(_shares(kernel.astype(np.float32) @ weights).max(1).min())
    return Model(langs, packed[picked], weights, (even + least) / 2 if len(langs) > 1 else 0.0)


def predict(text: Column, model: Model) -> Column:
    """struct<lang, score> of a whole text: ``und`` and 0 if it is null or has no letter."""

    @F.arrow_udf("struct<lang:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held(("langid", model.weights.tobytes()), lambda: Scorer(model))
        for texts in batches:
            langs, scores = own.predict(texts)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return run(text.cast("string"))


def accepted(text: Column, model: Model) -> Column:
    """True for a text scored ``model.floor`` or more, and for one of letters that is no ``babble``.  Never null.

    The score tells the languages learned from each other, but not a language without labels from
    noise; such a text stays.  Null, empty and letterless texts go, and so does babble below the floor.
    A model without languages keeps every text with a letter.
    """

    @F.arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held(("langid", model.weights.tobytes()), lambda: Scorer(model)) if model.langs else None
        for texts in batches:
            if own is None:
                yield pa.array([has_letter(t.as_py()) for t in texts], pa.bool_())
                continue
            langs, scores = own.predict(texts)
            yield pa.array([lang != UNKNOWN and (score >= model.floor or not babble(t.as_py())) for t, lang, score in zip(texts, langs, scores, strict=True)], pa.bool_())

    return run(text.cast("string"))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; repeated rows and null ids come out as they went in."""
    found = pick(docs, doc_id="bigint", text="string").select("doc_id", predict(F.col("text"), model).alias("p"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
