"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features: character n-grams of 1 to 3 letters (lower-cased, everything but letters becomes one space),
hashed to ``BUCKETS``; term frequency times inverse document frequency, scaled to length 1. Document
frequencies are counted over all training documents.

Training: follow-the-regularised-leader with elastic-net penalties (L1 keeps most weights at zero), on a
bounded sample: of each language the ``PER_LANGUAGE`` training rows with the smallest hashes of
id and text, equal rows once. The sample is dealt to ``SHARDS`` tasks; each pass starts from the mean state of the one
before. A fifth of the sample is not trained on: it gives the temperature that divides the
logits, the one with the least log-loss on a grid.

Languages are as many as the labels name; the model is a row of ``BUCKETS`` weights for each.

Defined results: null text, or text without a letter, is ``und`` with score 0, and so is every text when
there is nothing to learn from; equal probabilities go to the first language by name; repeated rows
are predicted each. lang, source and doc_id never enter a prediction.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pairjudge.llm.common import out_batch, slices, strings, written

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
PER_LANGUAGE = 1200
SHARDS = 4
PASSES = 3
UNKNOWN = "und"
#: FTRL: learning rate, its offset, L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.05, 0.05
TEMPERATURES = np.geomspace(0.05, 20, 97)
#: Characters whose n-grams are counted at a time.
RUN = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter; surrogates are none."""
    return np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), dtype=bool)


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of the whole text; None if it has no letter."""
    if not text:
        return None
    out, some = np.zeros(BUCKETS), False
    for start in range(0, len(text), RUN):
        part = text[max(0, start - max(ORDERS) + 1):start + RUN].lower()
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        letter = _letters()[code]
        some = some or bool(letter.any())
        code = np.where(letter, code, np.uint32(32))
        code = code[np.append(True, letter[1:] | letter[:-1])]  # one space between words
        gram = np.zeros(len(code), dtype=np.uint32)
        for n in range(1, max(ORDERS) + 1):
            gram = (gram[: len(code) - n + 1] * np.uint32(0x01000193)) ^ (code[n - 1:] * np.uint32(0x9E3779B1))
            if n in ORDERS and len(gram):
                mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
                out += np.bincount(mixed >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return out if some else None


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # a row per language
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, found: np.ndarray) -> np.ndarray:
        x = found * self.idf
        return self.weights @ (x / np.sqrt(x @ x)) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        found = counts(text) if self.languages else None
        if found is None:
            return UNKNOWN, 0.0
        p = softmax(self.logits(found) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL-proximal weights of a state: zero where L1 holds them."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


FREQUENCY = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("df", T.LongType())])
EXAMPLE = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("order", T.LongType()), T.StructField("shard", T.IntegerType()),
                        T.StructField("at", T.BinaryType()), T.StructField("value", T.BinaryType())])
STATE = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("z", T.BinaryType()), T.StructField("n", T.BinaryType())])
LOSS = T.StructType([T.StructField("at", T.IntegerType()), T.StructField("loss", T.DoubleType())])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all of them, and how many there are."""

    def task(batches):
        df = np.zeros(BUCKETS + 1, dtype=np.int64)
        for batch in slices(batches):
            for text in strings(batch.column("text")):
                if (found := counts(text)) is not None:
                    df[:-1] += found > 0
                    df[-1] += 1
        at = np.flatnonzero(df)
        yield out_batch(FREQUENCY, {"bucket": at.tolist(), "df": df[at].tolist()})

    df = np.zeros(BUCKETS + 1, dtype=np.int64)
    for r in texts.select("text").mapInArrow(task, FREQUENCY).groupBy("bucket").agg(F.sum("df").alias("df")).collect():  # a row per bucket
        df[r["bucket"]] = r["df"]
    return df[:-1], int(df[-1])


def sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """Of each language the ``per_language`` rows with the smallest hashes of id and text; equal rows count once."""
    rows = labelled.select("lang", "text", F.xxhash64("doc_id", "text").alias("order"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order"))
    chosen = rows.select("lang", "order").distinct().withColumn("rank", rank).where(F.col("rank") <= per_language).select("lang", "order")
    return rows.join(F.broadcast(chosen), ["lang", "order"]).dropDuplicates(["lang", "order"]).select("lang", "text", "order")


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, passes: int = PASSES) -> Model:
    """Train on rows of doc_id, text, lang."""
    spark = labelled.sparkSession
    labelled = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        "text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    df, total = document_frequencies(labelled)
    idf = np.log((1 + total) / (1 + df)) + 1
    languages = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())  # a row per language
    k = len(languages)
    if not k or not total:
        return Model([], idf, np.zeros((0, BUCKETS)), np.zeros(0))
    number = {name: i for i, name in enumerate(languages)}

    def examples(batches):
        for batch in slices(batches):
            cols: dict[str, list] = {f.name: [] for f in EXAMPLE}
            for lang, text, order in zip(strings(batch.column("lang")), strings(batch.column("text")), strings(batch.column("order"))):
                if (found := counts(text)) is None:
                    continue
                x = found * idf
                x /= np.sqrt(x @ x)
                at = np.flatnonzero(x)
                cols["label"].append(number[lang])
                cols["order"].append(order)
                cols["shard"].append(order // 5 % SHARDS if order % 5 else -1)  # -1: for the temperature
                cols["at"].append(at.astype("<i4").tobytes())
                cols["value"].append(x[at].astype("<f8").tobytes())
            yield out_batch(EXAMPLE, cols)

    held = written(sample(labelled, per_language).mapInArrow(examples, EXAMPLE), "examples")
    z, n = np.zeros((k, BUCKETS + 1)), np.zeros((k, BUCKETS + 1))  # the last column is the bias
    for _ in range(passes):
        state = spark.sparkContext.broadcast((z, n))

        def one_pass(key, rows):
            z, n = (a.copy() for a in state.value)
            rows = rows.sort_by([("order", "ascending"), ("label", "ascending"), ("at", "ascending")])
            for label, at, value in zip(*(rows.column(c).to_pylist() for c in ("label", "at", "value"))):
                at = np.append(np.frombuffer(at, "<i4"), BUCKETS)
                value = np.append(np.frombuffer(value, "<f8"), 1.0)
                zs, ns = z[:, at], n[:, at]
                w = weights(zs, ns)
                error = softmax(w @ value)
                error[label] -= 1
                g = error[:, None] * value
                grown = ns + g * g
                z[:, at] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / ALPHA * w
                n[:, at] = grown
            return _table(STATE, {"shard": [key[0].as_py()], "z": [z.tobytes()], "n": [n.tobytes()]})

        states = held.where("shard >= 0").groupBy("shard").applyInArrow(one_pass, STATE).orderBy("shard").collect()  # a model per shard
        if states:
            z = np.mean([np.frombuffer(r["z"]).reshape(k, -1) for r in states], axis=0)
            n = np.mean([np.frombuffer(r["n"]).reshape(k, -1) for r in states], axis=0)
    w = weights(z, n)
    model = Model(languages, idf, w[:, :-1], w[:, -1])
    model.temperature = _temperature(held.where("shard < 0"), model)
    return model


def _table(schema: T.StructType, columns: dict[str, list]):
    import pyarrow as pa

    return pa.Table.from_batches([out_batch(schema, columns)])


def _temperature(examples: DataFrame, model: Model) -> float:
    """The temperature with the least log-loss on the examples; 1 without any."""
    w, b = model.weights, model.bias

    def task(batches):
        loss = np.zeros(len(TEMPERATURES))
        for batch in batches:
            for label, at, value in zip(*(batch.column(c).to_pylist() for c in ("label", "at", "value"))):
                logits = w[:, np.frombuffer(at, "<i4")] @ np.frombuffer(value, "<f8") + b
                p = softmax(logits[None, :] / TEMPERATURES[:, None])[:, label]
                loss -= np.log(np.maximum(p, 1e-12))
        yield out_batch(LOSS, {"at": list(range(len(loss))), "loss": loss.tolist()})

    rows = examples.mapInArrow(task, LOSS).groupBy("at").agg(F.sum("loss").alias("loss")).collect()  # a row per temperature
    best = min(rows, key=lambda r: (round(r["loss"], 9), abs(np.log(TEMPERATURES[r["at"]]))), default=None)
    return float(TEMPERATURES[best["at"]]) if best and best["loss"] > 0 else 1.0


PREDICTION = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("held_out", T.BooleanType()),
                           T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        for batch in slices(batches):
            found = [shared.value.predict(text) for text in strings(batch.column("text"))]
            yield out_batch(PREDICTION, {"doc_id": strings(batch.column("doc_id")), "held_out": strings(batch.column("held_out")),
                                         "lang_pred": [x for x, _ in found], "score": [x for _, x in found]})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                            held_out(F.col("doc_id")).alias("held_out")).mapInArrow(task, PREDICTION)


def training_rows(documents: DataFrame) -> DataFrame:
    return documents.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")


def keep_identified(documents: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows whose language is told with a score of ``least`` or more; all columns kept."""
    import pyarrow as pa

    shared = documents.sparkSession.sparkContext.broadcast(model)
    plain = documents.toDF(*(f"c{i}" for i in range(len(documents.columns))))  # names with dots are no names to a Python stage
    text = f"c{documents.columns.index('text')}"

    def task(batches):
        for batch in slices(batches, text):
            found = [shared.value.predict(t) for t in strings(batch.column(text))]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found]))

    return plain.mapInArrow(task, plain.schema).toDF(*documents.columns)
