"""Language of texts: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of the n-grams, features, languages at most, texts learned from per language.
ORDERS = (1, 2, 3)
FEATURES = 1 << 16
MOST_LANGUAGES = 1000
SAMPLE = 2000
UNKNOWN = "und"
_SLICE = 1 << 18


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: is it a letter; its lower case (one code point, else unchanged)."""
    lower = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, dtype=bool)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            letter[code] = True
            small = char.lower()
            if len(small) == 1:
                lower[code] = ord(small)
    return letter, lower


def features(texts: list[str], n_features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts one after another, and how many each text has.

    Letters count in lower case, all else as one kind of blank; n-grams cross
    words, but those without a letter are left out.  Nothing is cut off.
    """
    letter, lower = _letters()
    sizes = [len(t) for t in texts]
    codes = np.frombuffer(" ".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letter[codes]
    codes = np.where(is_letter, lower[codes], np.uint32(32)).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), np.asarray(sizes, dtype=np.int64) + 1)
    numbers, owners = [], []
    for n in ORDERS:
        count = len(codes) - n + 1
        if count <= 0:
            continue
        value = np.full(count, n, dtype=np.uint64)
        any_letter = np.zeros(count, dtype=bool)
        for i in range(n):
            value = (value * np.uint64(0x9E3779B97F4A7C15) + codes[i:i + count])
            value ^= value >> np.uint64(29)
            any_letter |= is_letter[i:i + count]
        # the blank behind each text keeps n-grams of two texts apart but for blanks
        own = owner[:count]
        keep = any_letter & (own == owner[n - 1:n - 1 + count])
        numbers.append((value[keep] * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % n_features)
        owners.append(own[keep])
    if not numbers:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    number, own = np.concatenate(numbers), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return number[order], np.bincount(own, minlength=len(texts))


def slices(texts: list[str]) -> list[list[int]]:
    """Positions of the texts in groups of about a quarter of a million characters (a longer text is alone)."""
    groups, size = [[]], 0
    for i, text in enumerate(texts):
        if groups[-1] and size + len(text) > _SLICE:
            groups.append([])
            size = 0
        groups[-1].append(i)
        size += len(text)
    return groups if groups[-1] else []


def learn(docs: DataFrame, held_out: Column, text: str = "text", lang: str = "lang",
          row_id: str = "doc_id", sample: int = SAMPLE) -> tuple[list[str], np.ndarray] | None:
    """Languages and their matrix (features x languages) of log-probabilities; last row: priors.

    Learns from rows with a language that are not held out: per language from
    about ``sample`` whole texts, chosen by the hash of their id.  Counts are
    summed by Spark; what comes to the driver is languages x features numbers,
    with at most MOST_LANGUAGES languages (more are refused: ValueError).
    Priors are the shares of all learnable rows.  None if there are none.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~F.coalesce(held_out, F.lit(False)))
    rows = known.groupBy(lang).count().limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not rows:
        return None
    totals = {r[lang]: r["count"] for r in rows}
    langs = sorted(totals)
    n_features = FEATURES
    while n_features * len(langs) > FEATURES * 64 and n_features > 1 << 12:
        n_features //= 2
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample / totals[k]))])
    place = F.pmod(F.xxhash64(F.col(row_id).cast("string"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = known.where(place < share[F.col(lang)]).select(F.col(text).alias("text"), F.col(lang).alias("lang"))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, texts in batch.groupby("lang")["text"]:
                texts = texts.tolist()
                for group in slices(texts):
                    found, _ = features([texts[i] for i in group], n_features)
                    sums.setdefault(name, np.zeros(n_features, np.int64))
                    sums[name] += np.bincount(found, minlength=n_features)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pd.DataFrame({"lang": name, "feature": at, "n": total[at]})

    counts = np.zeros((n_features + 1, len(langs)))
    summed = chosen.mapInPandas(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    got = summed.toPandas()
    counts[got["feature"], [langs.index(x) for x in got["lang"]]] = got["n"]
    smooth = counts[:-1] + 0.1
    matrix = np.log(smooth / smooth.sum(axis=0))
    prior = np.log(np.array([totals[k] for k in langs]) / sum(totals.values()))
    return langs, np.vstack([matrix, prior]).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray] | None, text: str = "text",
            keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with lang_pred and score, from the text alone.

    The matrix is broadcast (features x languages floats, both bounded); texts
    are scored whole, in numpy, by sums over their sparse features.  ``score``
    is the posterior of the predicted language.  Ties go to the smaller name.
    Null texts and texts without a letter give ``und`` and score 0, as does
    every text when there was nothing to learn from.
    """
    langs, matrix = model or ([], np.zeros((FEATURES + 1, 0), np.float32))
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    fields = docs.select(*keep).schema
    schema = fields.add("lang_pred", "string").add("score", "double")
    source = docs.select(F.struct(*keep).alias("own"), F.col(text).alias("text"))

    def score(batches):
        weights = shared.value
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            best, sure = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            for group in slices(texts) if langs else []:
                found, sizes = features([texts[i] for i in group], len(weights) - 1)
                used = np.flatnonzero(sizes)
                if not len(used):
                    continue
                starts = np.concatenate(([0], np.cumsum(sizes[used])[:-1]))
                sums = np.add.reduceat(weights[found], starts, axis=0, dtype=np.float64) + weights[-1]
                top = sums.argmax(axis=1)
                at = np.asarray(group)[used]
                best[at] = np.asarray(langs, dtype=object)[top]
                sure[at] = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*batch.column("own").flatten(), pa.array(best, pa.string()), pa.array(sure)], names=schema.names)

    return source.mapInArrow(score, schema)


def op4_language_id(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs = docs.withColumn("held_out", F.coalesce(held_out, F.lit(False)))
    model = learn(docs, F.col("held_out"))
    return predict(docs, model, keep=("doc_id", "held_out"))
