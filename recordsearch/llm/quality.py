"""Quality and toxicity of documents by co-training two views.

One view sees the text (words and how they begin, runs of symbols, shape), the other
page metadata (source, language, length, lines).  Over some rounds each view
labels all unlabelled documents it is sure of for the other, which brings new
features and what to expect of them; then both are calibrated and combined.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordsearch.llm import words
from recordsearch.llm.common import checkpointed

#: Bounds of what is fitted on: labelled rows per combination of labels, features of a view from labels and from pseudo-labels.
LABELLED, MOST_FEATURES, MOST_NEW = 3000, 512, 256
ROUNDS = 2
#: A pseudo-label needs this calibrated probability; it counts less than a label.
SURE, PSEUDO_WEIGHT = 0.97, 0.3
#: A feature needs this many documents and this many standard errors between the classes.
LEAST_DOCS, LEAST_Z = 5, 4.0
#: By pseudo-labels: the logarithm of the ratio between the classes, less two standard errors, must reach this.
LEAST_RATIO = 1.0
#: Rows of counts that a task holds before it sums them up.
_HELD = 1 << 18
#: Bytes of the beginnings of words that are features beside the words.
STEMS = (4, 5)
TARGETS = ("quality", "toxic")
CLASSES = tuple(f"{t}{k}" for t in TARGETS for k in (0, 1))
VIEWS = ("text", "page")

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'-"]] = True


def _named(name: str, bins: np.ndarray) -> np.ndarray:
    base = np.uint64(zlib.crc32(name.encode()) << 20)
    return words.mix(base + bins.astype(np.int64).astype(np.uint64), 7)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(part / np.maximum(whole, 1) + 1 / 256) + 8)


def text_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text: (text number, feature), sorted by both."""
    raw, at = words.joined(texts)
    upper = (raw >= 65) & (raw <= 90)
    lower = raw.copy()
    lower[upper] += 32
    letter = _LETTER[raw]
    hashes, starts, ends = words.run_hashes(lower, letter)
    symbols, places, stops = words.run_hashes(raw, _SYMBOL[raw])
    n = len(texts)

    def per_text(where, weights=None):
        return np.bincount(np.searchsorted(at, where, side="right") - 1, weights=weights, minlength=n)

    own = np.searchsorted(at, starts, side="right") - 1
    tokens = np.stack([own.astype(np.uint64), hashes])
    order = np.lexsort(tokens[::-1])
    own, hashes = own[order], hashes[order]
    new = np.ones(len(own), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
    counts, distinct = np.bincount(own, minlength=n), np.bincount(own[new], minlength=n)
    letters = per_text(starts, ends - starts)
    marks = per_text(places, stops - places)
    shape = [("upper", _share(per_text(np.flatnonzero(upper)), letters)), ("distinct", np.floor(10 * distinct / np.maximum(counts, 1))),
             ("length", np.floor(2 * letters / np.maximum(counts, 1))), ("marks", _share(marks, letters + marks)),
             ("words", np.floor(2 * np.log2(counts + 1)))]
    lengths = ends - starts
    first_own = np.searchsorted(at, starts, side="right") - 1
    stems = []
    for k in STEMS:  # how a word begins, for families of words
        long = np.flatnonzero(lengths >= k)
        value = np.zeros(len(long), np.uint64)
        for i in range(k):
            value = value * np.uint64(0x9E3779B97F4A7C15) + lower[starts[long] + i] + np.uint64(1)
        stems.append((first_own[long], words.mix(value, 40 + k)))
    every = np.arange(n)
    owner = np.concatenate([own[new], *[o for o, _ in stems], np.searchsorted(at, places, side="right") - 1, *[every] * len(shape)])
    value = np.concatenate([hashes[new], *[v for _, v in stems], words.mix(symbols, 3), *[_named(k, v) for k, v in shape]])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    keep = np.ones(len(owner), dtype=bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[keep], value[keep]


def page_features(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of the metadata, in the form of text_features."""
    n = len(batch)
    chars = np.array([len(t) for t in batch["text"]], dtype=float)
    lines = np.array([t.count("\n") + 1 for t in batch["text"]], dtype=float)
    kinds = [np.array([zlib.crc32(f"{name}={v}".encode("utf-8", "surrogatepass")) for v in batch[name]], dtype=np.uint64) << np.uint64(8)
             for name in ("source", "lang")]
    bins = [_named(k, np.floor(2 * np.log2(v + 1))) for k, v in (("chars", chars), ("lines", lines), ("per line", chars / lines))]
    value = np.concatenate([words.mix(k, 11) for k in kinds] + bins)
    return np.tile(np.arange(n), len(kinds) + len(bins)), value


def _views(batch: pd.DataFrame):
    """(rows, (row number, feature) of the text view, the same of the page view) for groups of neighbouring rows."""
    batch = batch.assign(text=[t if isinstance(t, str) else "" for t in batch["text"]])
    for part in words.groups(batch["text"].tolist()):
        rows = batch.iloc[part]
        yield part, (text_features(rows["text"].tolist()), page_features(rows))


class Linear:
    """Logistic regression over a few hundred 0/1 features, calibrated on rows it did not see.

    Weights are drawn to ``prior``; one without rows of its own stays there.
    """

    def __init__(self, width: int, prior: np.ndarray | None = None):
        self.prior = np.zeros(width) if prior is None else prior
        self.weights, self.bias, self.scale, self.shift = self.prior.copy(), 0.0, 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 150) -> None:
        squares = np.full(x.shape[1] + 1, 1e-6)
        total = weight.sum()
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))
            slip = (p - y) * weight / total
            slope = np.append(slip @ x + penalty * (self.weights - self.prior) / total, slip.sum())
            squares += slope ** 2
            move = 0.5 * slope / np.sqrt(squares)
            self.weights -= move[:-1]
            self.bias -= move[-1]

    def calibrate(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        one = Linear(1)
        raw = (x @ self.weights + self.bias)[:, None]
        one.fit(raw, y, weight, penalty=1e-3)
        self.scale, self.shift = max(float(one.weights[0]), 0.0), float(one.bias)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x @ self.weights + self.bias) * self.scale + self.shift, -12, 12)


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _fitted(x: list[np.ndarray], priors: list[np.ndarray], y: np.ndarray, weight: np.ndarray, held: np.ndarray) -> tuple[list[Linear], Linear]:
    """Both views, calibrated on the rows ``held`` out, and how they are combined."""
    views = []
    for own, prior in zip(x, priors, strict=True):
        view = Linear(own.shape[1], prior)
        view.fit(own[~held], y[~held], weight[~held])
        view.calibrate(own[held], y[held], weight[held])
        views.append(view)
    both = Linear(2)
    both.fit(np.stack([v.logit(o[held]) for v, o in zip(views, x, strict=True)], axis=1), y[held], weight[held], penalty=0.1, steps=300)
    both.weights = np.maximum(both.weights, 0)
    return views, both


def _counted(sides: dict[str, np.ndarray], own: np.ndarray, feature: np.ndarray, view: int) -> pd.DataFrame:
    """How many rows of each side have a feature; in the row of view + 2, how many rows a side has."""
    some = np.any([s > 0 for s in sides.values()], axis=0)
    own, feature = own[some[own]], feature[some[own]]
    names, place = np.unique(feature, return_inverse=True)
    out = {k: np.append(np.bincount(place, s[own], len(names)), s.sum()) for k, s in sides.items()}
    return pd.DataFrame({"view": np.append(np.full(len(names), view), view + 2), "feature": np.append(names.view(np.int64), 0)} | out)


def _summed(frames):
    """The counts of a task, added up in bounded memory."""
    held: list[pd.DataFrame] = []
    size = 0
    for frame in frames:
        held.append(frame)
        size += len(frame)
        if size > _HELD:
            one = pd.concat(held).groupby(["view", "feature"], as_index=False).sum()
            if len(one) > _HELD // 2:
                yield one
                one = one.iloc[:0]
            held, size = [one], len(one)
    if held:
        yield pd.concat(held).groupby(["view", "feature"], as_index=False).sum()


def _by_labels(batches):
    def frames():
        for batch in batches:
            sides = {f"{t}{k}": (batch[t] == k).to_numpy(dtype=float) for t in TARGETS for k in (0, 1)}
            for part, views in _views(batch):
                for view, found in enumerate(views):
                    yield _counted({k: v[part] for k, v in sides.items()}, *found, view)

    yield from _summed(frames())


def _logits(models: dict, views, n: int) -> dict[str, np.ndarray]:
    """For each target the calibrated logits of n rows, a column for each view."""
    found = {t: np.zeros((n, 2)) for t in TARGETS}
    for t in TARGETS:
        if isinstance(models[t], float):
            continue
        names, fitted, _ = models[t]
        for view, (own, feature) in enumerate(views):
            at, hit = _places(names[view], feature)
            m = fitted[view]
            raw = np.bincount(own[hit], m.weights[at[hit]], minlength=n) if len(names[view]) else np.zeros(n)
            found[t][:, view] = np.clip((raw + m.bias) * m.scale + m.shift, -12, 12)
    return found


def _by_the_other_view(shared):
    """Tasks that count the features of each view by the labels that the other view is sure of."""
    def count(batches):
        def frames():
            for batch in batches:
                for part, views in _views(batch):
                    n = part.stop - part.start
                    logits = _logits(shared.value, views, n)
                    for view, found in enumerate(views):
                        sure = {t: _sigmoid(logits[t][:, 1 - view]) for t in TARGETS}
                        sides = {f"{t}{k}": ((p >= SURE) if k else (p <= 1 - SURE)).astype(float) for t, p in sure.items() for k in (0, 1)}
                        yield _counted(sides, *found, view)

        yield from _summed(frames())

    return count


def _feature_counts(rows: DataFrame, count) -> DataFrame:
    """(view, feature, one column for each class of a target), pre-aggregated in tasks and by Spark."""
    fields = "view int, feature long, " + ", ".join(f"{c} double" for c in CLASSES)
    return rows.mapInPandas(count, fields).groupBy("view", "feature").agg(*[F.sum(c).alias(c) for c in CLASSES])


def _sizes(counts: DataFrame) -> dict[int, dict[str, float]]:
    """How many rows of each class were counted for a view."""
    found = {r["view"] - 2: r.asDict() for r in counts.where("view >= 2").collect()}
    return {v: {c: found.get(v, {}).get(c, 0.0) for c in CLASSES} for v in (0, 1)}


def _z(t: str, a: float, b: float):
    """Standard errors between the classes of a target."""
    p, q = (F.col(f"{t}0") + 0.5) / (a + 1), (F.col(f"{t}1") + 0.5) / (b + 1)
    pooled = (F.col(f"{t}0") + F.col(f"{t}1") + 1) / (a + b + 2)
    return F.abs(q - p) / F.sqrt(pooled * (1 - pooled) * (1 / a + 1 / b))


def _strongest(counts: DataFrame, view: int, t: str, strength, least: float, most: int) -> pd.DataFrame:
    """The ``most`` features of a view that tell the classes apart best, ties to the smaller one."""
    rows = counts.where((F.col("view") == view) & (F.col(f"{t}0") + F.col(f"{t}1") >= LEAST_DOCS))
    rows = rows.select("feature", strength.alias("s"), (F.col(f"{t}1") + 0.5).alias("one"), (F.col(f"{t}0") + 0.5).alias("zero"))
    return rows.where(F.col("s") >= least).orderBy(F.desc("s"), "feature").limit(most).toPandas()


def _expected(t: str, size: dict[str, float]):
    """Least size of the logarithm of the ratio between the classes, by pseudo-labels, and the same for given counts."""
    a, b = size[f"{t}0"] + 1, size[f"{t}1"] + 1
    ratio = F.log((F.col(f"{t}1") + 0.5) / b) - F.log((F.col(f"{t}0") + 0.5) / a)
    error = F.sqrt(1 / (F.col(f"{t}0") + 0.5) + 1 / (F.col(f"{t}1") + 0.5))

    def weight(one, zero):
        own = np.log(one / b) - np.log(zero / a)
        return PSEUDO_WEIGHT * np.sign(own) * np.maximum(np.abs(own) - 2 * np.sqrt(1 / one + 1 / zero), 0)

    return F.abs(ratio) - 2 * error, weight


def _chosen(told: DataFrame, given: DataFrame | None, t: str, sizes: dict, pseudo: dict) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each view the features of a target, sorted, and the weights that the pseudo-labels lead to expect."""
    names, priors = [], []
    for view in (0, 1):
        own = _strongest(told, view, t, _z(t, sizes[f"{t}0"], sizes[f"{t}1"]), LEAST_Z, MOST_FEATURES)["feature"].to_numpy(dtype=np.int64)
        expected = pd.Series(dtype=float)
        if given is not None and pseudo[view][f"{t}0"] and pseudo[view][f"{t}1"]:
            strength, weight = _expected(t, pseudo[view])
            new = _strongest(given, view, t, strength, LEAST_RATIO, MOST_NEW)
            also = given.where((F.col("view") == view) & F.col("feature").isin(own.tolist())).select(
                "feature", (F.col(f"{t}1") + 0.5).alias("one"), (F.col(f"{t}0") + 0.5).alias("zero")).toPandas()
            both = pd.concat([new[["feature", "one", "zero"]], also]).drop_duplicates("feature").set_index("feature")
            expected = weight(both["one"], both["zero"])
            own = np.union1d(own, new["feature"].to_numpy(dtype=np.int64))
        names.append(np.sort(own))
        priors.append(expected.reindex(names[-1]).fillna(0.0).to_numpy(dtype=float))
    return names, priors


def _sample(known: DataFrame, listed: np.ndarray) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """The labelled rows of the sample, and which of the ``listed`` features they have: (row, place in the list)."""
    spread = known.sparkSession.sparkContext.broadcast(listed)

    def code(batches):
        for batch in batches:
            has: list[list] = [[] for _ in range(len(batch))]
            for part, views in _views(batch):
                for own, feature in views:
                    at, hit = _places(spread.value, feature)
                    for i, f in zip(own[hit], at[hit], strict=True):
                        has[part.start + i].append(int(f))
            yield batch[["doc_id", *TARGETS, "weight"]].assign(has=[sorted(h) for h in has])

    sample = known.mapInPandas(code, "doc_id long, quality double, toxic double, weight double, has array<int>").toPandas()
    sample["size"] = sample["has"].map(len)
    sample["first"] = sample["has"].map(lambda h: tuple(h))
    sample = sample.sort_values(["doc_id", "size", "first"], kind="stable").reset_index(drop=True)
    rows = np.repeat(np.arange(len(sample)), sample["size"])
    return sample, rows, np.concatenate([*sample["has"].map(lambda x: np.asarray(x, dtype=np.int64)), np.zeros(0, np.int64)])


def _fit_round(known: DataFrame, chosen: dict) -> dict:
    """For each target of ``chosen`` its features, fitted views and their combination."""
    listed = np.unique(np.concatenate([f for names, _ in chosen.values() for f in names]))
    sample, rows, places = _sample(known, listed)
    held = np.array([zlib.crc32(f"held {i}".encode()) % 10 < 3 for i in sample["doc_id"]])
    model = {}
    for t, (names, priors) in chosen.items():
        y = sample[t].to_numpy()
        has_label = ~np.isnan(y)
        number = np.cumsum(has_label) - 1
        x = []
        for features in names:
            column = np.full(len(listed), -1)
            column[np.searchsorted(listed, features)] = np.arange(len(features))
            own = has_label[rows] & (column[places] >= 0)
            view = np.zeros((has_label.sum(), len(features)), dtype=np.float32)
            view[number[rows[own]], column[places[own]]] = 1
            x.append(view)
        if len(np.unique(y[has_label & held])) < 2 or len(np.unique(y[has_label & ~held])) < 2:
            fold = np.zeros(has_label.sum(), dtype=bool)  # too few rows to hold some out: calibrate on all
            fold[::2] = True
        else:
            fold = held[has_label]
        model[t] = (names, *_fitted(x, priors, y[has_label], sample["weight"].to_numpy()[has_label], fold))
    return model


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """For each target: features of both views and the fitted models; a number if all labels agree.

    Fitted on at most about LABELLED labelled documents per combination of
    labels (chosen by hash, weighted back to their share).  In each round all
    other documents, whole texts, are scored in tasks; what a view is sure of
    is counted by Spark as features of the other view.  These counts bring
    features that no label has, and the weights to expect.  The driver gets
    MOST_FEATURES and MOST_NEW features a view and, per sampled document,
    which of them it has.  Rows of ``labels`` with a null target are left out
    for it; of contradicting rows the worse label counts.
    """
    labels = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").cast("double").alias("quality"), F.max("toxic").cast("double").alias("toxic")).where("doc_id IS NOT NULL")
    cells = labels.groupBy(*TARGETS).count().collect()  # nine rows at most: 0, 1 or null each
    if len(cells) > 9:
        raise ValueError("labels must be 0, 1 or null")
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    share, weight = F.lit(None).cast("double"), F.lit(None).cast("double")
    for c in cells:
        same = F.lit(True)
        for t in TARGETS:
            same = same & F.col(t).eqNullSafe(F.lit(c[t]).cast("double"))
        share = F.when(same, F.lit(min(1.0, LABELLED / c["count"]))).otherwise(share)
        weight = F.when(same, F.lit(max(1.0, c["count"] / LABELLED))).otherwise(weight)
    chosen = labels.withColumn("weight", weight).where(place < share)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source")
    known = checkpointed(plain.join(F.broadcast(chosen), "doc_id"))  # about 9 x LABELLED rows at most
    others = plain.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
    sizes = known.agg(*[F.count_if(F.col(t) == k).alias(f"{t}{k}") for t in TARGETS for k in (0, 1)]).first()
    mixed = [t for t in TARGETS if sizes[f"{t}0"] and sizes[f"{t}1"]]
    model: dict = {t: 1.0 if sizes[f"{t}1"] else 0.0 for t in TARGETS if t not in mixed}
    if not any(sizes):
        return {"quality": 1.0, "toxic": 0.0}
    if not mixed:
        return model
    told = checkpointed(_feature_counts(known, _by_labels))
    given, pseudo = None, {}
    for step in range(ROUNDS + 1):
        model |= _fit_round(known, {t: _chosen(told, given, t, sizes, pseudo) for t in mixed})
        if step < ROUNDS:
            shared = docs.sparkSession.sparkContext.broadcast(dict(model))
            given = _feature_counts(others, _by_the_other_view(shared))
            seen = F.greatest(*[F.col(f"{t}0") + F.col(f"{t}1") for t in TARGETS])
            given = checkpointed(given.where((F.col("view") >= 2) | (seen >= LEAST_DOCS)))
            pseudo = _sizes(given)
    return model


def _places(names: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each feature in the sorted names, and whether it is there."""
    signed = feature.view(np.int64)
    at = np.minimum(np.searchsorted(names, signed), max(len(names) - 1, 0))
    return at, names[at] == signed if len(names) else np.zeros(len(signed), dtype=bool)


def _scored(docs: DataFrame, model: dict, keep: list[str]) -> DataFrame:
    """(own, quality_score, toxic_score): ``own`` holds the columns ``keep``, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # names of the caller's columns may clash with those read here
    read = ("text", "lang", "source")
    source = docs.select(F.struct(*keep).alias("own"), *[c for c in read if c not in keep])
    schema = source.select("own").schema.add("quality_score", "double").add("toxic_score", "double")

    def run(batches):
        models = shared.value
        for batch in batches:
            own = dict(zip(keep, batch.column("own").flatten(), strict=True))
            seen = pd.DataFrame({c: (own[c] if c in own else batch.column(c)).to_pandas() for c in read})
            logits = {t: np.zeros((batch.num_rows, 2)) for t in TARGETS}
            for part, views in _views(seen):
                for t, found in _logits(models, views, part.stop - part.start).items():
                    logits[t][part] = found
            scores = []
            for t in TARGETS:
                if isinstance(models[t], float):
                    scores.append(np.full(batch.num_rows, models[t]))
                else:
                    both = models[t][2]
                    scores.append(_sigmoid(np.clip(logits[t] @ both.weights + both.bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("own"), *map(pa.array, scores)], names=schema.names)

    return source.mapInArrow(run, schema)


def _good(least_quality: float, most_toxic: float):
    return (F.col("quality_score") >= least_quality) & (F.col("toxic_score") < most_toxic)


def classify(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), least_quality: float = 0.5,
             most_toxic: float = 0.3) -> DataFrame:
    """Score every document; ``accepted`` says that it is good enough and not toxic.

    Null texts count as empty, texts of any length are read whole; null source
    or language is a value of its own.  Repeated rows get equal scores; a score
    at ``least_quality`` is accepted, one at ``most_toxic`` is not.  Without
    labels, or with labels of one kind only, that label is the score (no
    labels: good and not toxic).  An empty table stays empty.  Columns beyond
    doc_id, text, lang and source are passed on if named in ``keep``; one named
    as a result is left out for it.
    """
    scored = _scored(docs, train(docs, labels), list(keep)).withColumn("accepted", _good(least_quality, most_toxic))
    results = ("quality_score", "toxic_score", "accepted")
    return scored.select(*[F.col("own")[c].alias(c) for c in keep if c not in results], *results)


def accepted_documents(docs: DataFrame, labels: DataFrame, least_quality: float = 0.5, most_toxic: float = 0.3) -> DataFrame:
    """The documents that ``classify`` accepts, with exactly their own columns, whatever these are called."""
    scored = _scored(docs, train(docs, labels), docs.columns)
    return scored.where(_good(least_quality, most_toxic)).select("own.*")


def op1_quality(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
