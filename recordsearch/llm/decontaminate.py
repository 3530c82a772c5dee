"""Benchmark questions in documents, also when their numbers, names or units were changed.

Texts become templates: numbers, units behind numbers and capitalised names
are typed slots, all else stays as a word in lower case.  A capitalised word
at the beginning of a sentence may be a name or not, so every text has two
templates, one for either reading.  Windows of a question's template are
looked up in those of the documents by hash; then one value of a slot must
always stand for one other value.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordsearch.llm import words

#: Tokens of a window; share of a question's windows that makes a document contaminated.
WINDOW, LEAST = 8, 0.5
#: Windows of the benchmark that are broadcast together; a larger benchmark takes several passes.
BLOCK = 1 << 20
#: Tokens that a document may have more or fewer between two windows of one occurrence.
SHIFT = 3
UNITS = tuple("""kg g mg lb lbs oz ton tons km m cm mm mile miles meter meters metre metres foot feet inch inches yard yards
    second seconds minute minutes hour hours day days week weeks month months year years dollar dollars euro euros cent
    cents pound pounds liter liters litre litres ml percent degrees mph kmh watt watts volt volts""".split())

_BYTE = np.arange(256)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_TOKEN = _DIGIT | (_BYTE >= 65) & (_BYTE <= 90) | (_BYTE >= 97) & (_BYTE <= 122) | (_BYTE >= 128)
_LOWER = (_BYTE >= 97) & (_BYTE <= 122)
_BLANK = np.isin(_BYTE, [32, 9, 10, 11, 12, 13])
_STOP = np.isin(_BYTE, list(b".!?:;\"([{"))
#: Operators between two numbers are part of the template.
_OPERATOR = np.zeros(256, np.uint64)
_OPERATOR[list(b"+-*/=<>^%")] = words.mix(np.arange(9, dtype=np.uint64), 57)
_POINT = np.isin(_BYTE, list(b".,"))
_SLOT = words.mix(np.arange(4, dtype=np.uint64), 99)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _unit_hashes() -> np.ndarray:
    raw, _ = words.joined(list(UNITS))
    return np.sort(words.run_hashes(raw, _TOKEN[raw])[0])


_UNIT = _unit_hashes()


def readings(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of all texts in order: each token's kind (0 word, 1 number, 2 unit, 3 name), value, operators before it, text number.

    In the first reading a capitalised word at the beginning of a sentence is
    a word, in the second a name.  Neighbouring names or units are one slot,
    as are the parts of a number around a point or comma.
    """
    raw, at = words.joined(texts)
    small = raw.copy()
    small[(raw >= 65) & (raw <= 90)] += 32
    accented = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97))
    small[accented + 1] += 32
    value, starts, ends = words.run_hashes(small, _TOKEN[raw])
    if not len(starts):
        return [(np.zeros(0, np.int8), value, value, starts)] * 2
    own = np.searchsorted(at, starts, side="right") - 1

    def within(mask, a, b):
        sums = np.concatenate(([0], np.cumsum(mask)))
        return sums[b] - sums[a]

    number = within(_DIGIT[raw], starts, ends) > 0
    upper = (raw[starts] >= 65) & (raw[starts] <= 90) | np.isin(starts, accented)
    tail = np.minimum(starts + 1 + np.isin(starts, accented), ends)
    mixed = within(_LOWER[raw] | (raw >= 128), tail, ends) > 0
    place = np.arange(len(raw))
    solid = np.maximum.accumulate(np.where(~_BLANK[raw], place, -1))
    before = np.where(starts > 0, solid[starts - 1], -1)
    inside = (before >= at[own]) & ~_STOP[raw[before]] & (within(raw == 10, np.maximum(before, 0), starts) == 0)
    beside = own[1:] == own[:-1]
    follows = np.concatenate(([False], number[:-1] & beside))
    tight = (starts[1:] - ends[:-1] == 1) & _POINT[raw[ends[:-1]]]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_OPERATOR[raw], dtype=np.uint64)))
    between = np.zeros(len(starts), np.uint64)
    between[1:] = np.where(number[1:] & number[:-1] & beside, sums[starts[1:]] - sums[ends[:-1]], np.uint64(0))
    found = []
    for name in (upper & mixed & inside, upper & mixed):
        kind = np.select([number, follows & np.isin(value, _UNIT), name], [1, 2, 3], 0).astype(np.int8)
        first = np.ones(len(kind), dtype=bool)
        first[1:] = (kind[1:] == 0) | (kind[1:] != kind[:-1]) | ~beside | (kind[1:] == 1) & ~tight
        heads = np.flatnonzero(first)
        found.append((kind[heads], np.add.reduceat(value, heads), between[heads], own[heads]))
    return found


def windows(kind: np.ndarray, value: np.ndarray, between: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, hash with the values of the slots, and first token of every window of k tokens of one text.

    A window with fewer words than slots says little; its values stay in it.
    """
    n = len(kind) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    slotted, valued = np.where(kind > 0, _SLOT[kind], value) + between, value + between
    open_, exact = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    literal = np.zeros(n, np.int64)
    for i in range(k):
        open_ = open_ * _PRIME + slotted[i:i + n]
        exact = exact * _PRIME + valued[i:i + n]
        literal += kind[i:i + n] == 0
    whole = np.flatnonzero(own[:n] == own[k - 1:])
    return words.mix(np.where(2 * literal >= k, open_, exact), k)[whole], words.mix(exact, k)[whole], whole


class Questions:
    """Templates of a block of questions, ready to be looked up.

    A question with fewer than WINDOW words beside its slots ("What is
    12 + 7?") is too common a template: its values must be the same.
    """

    def __init__(self, items: list[int], texts: list[str]):
        self.items, self.tokens, self.count = items, {}, {}
        found: dict[tuple, list] = defaultdict(list)
        for reading, (kind, value, between, own) in enumerate(readings(texts)):
            for i in range(len(items)):
                at = slice(*np.searchsorted(own, [i, i + 1]))
                one = kind[at], value[at], between[at]
                k = min(WINDOW, len(one[0]))
                if not k:
                    continue
                strict = int((one[0] == 0).sum() < WINDOW)
                hashes = windows(*one, np.zeros(len(one[0]), np.int64), k)
                self.tokens[reading, i], self.count[reading, i] = one, len(hashes[2])
                for h, p in zip(hashes[strict].tolist(), hashes[2].tolist(), strict=True):
                    found[reading, k, strict, h].append((i, p))
        known: dict[tuple, list] = defaultdict(list)
        for *look, h in found:
            known[tuple(look)].append(h)
        self.hashes = {look: np.array(sorted(h), dtype=np.uint64) for look, h in sorted(known.items())}
        self.places = dict(found)

    def matches(self, texts: list[str]) -> list[list[tuple[int, float]]]:
        """Of each text the questions (item, share of its windows) with a share of LEAST or more."""
        result: list[dict[int, float]] = [{} for _ in texts]
        for part in words.groups(texts):
            both = readings(texts[part])
            hits: dict[tuple[int, int, int], list] = defaultdict(list)
            made: dict[tuple[int, int], tuple] = {}
            for (reading, k, strict), known in self.hashes.items():
                if (reading, k) not in made:
                    made = {(reading, k): windows(*both[reading], k)}  # looks come in order, so one is held
                hashes, places = made[reading, k][strict], made[reading, k][2]
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                for n in np.flatnonzero(known[at] == hashes):
                    p = int(places[n])
                    for item, q in self.places[reading, k, strict, int(hashes[n])]:
                        hits[int(both[reading][3][p]), item, reading].append((p - q, p, q, k))
            for (text, item, reading), found in hits.items():
                share = self._share(reading, item, found, both[reading][1])
                if share >= LEAST:
                    own = result[part.start + text]
                    own[item] = max(own.get(item, 0.0), round(share, 6))
        return [sorted((self.items[i], share) for i, share in r.items()) for r in result]

    def _share(self, reading: int, item: int, found: list, value: np.ndarray) -> float:
        """Largest share of the question's windows in one occurrence with consistent slots."""
        found.sort()
        best, start = 0, 0
        for end in range(1, len(found) + 1):
            if end == len(found) or found[end][0] - found[end - 1][0] > SHIFT:
                if end - start > best:
                    best = max(best, self._consistent(reading, item, found[start:end], value))
                start = end
        return best / self.count[reading, item]

    def _consistent(self, reading: int, item: int, found: list, value: np.ndarray) -> int:
        own_kind, own_value, _ = self.tokens[reading, item]
        pairs: Counter = Counter()
        in_window: dict[tuple[int, int], set] = {}
        for _, p, q, k in found:
            slots = {(int(own_kind[q + i]), int(own_value[q + i]), int(value[p + i])) for i in range(k) if own_kind[q + i]}
            in_window[p, q] = slots
            pairs.update(slots)
        there: dict = {}
        back: dict = {}
        for (slot, a, b), _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
            if (slot, a) not in there and (slot, b) not in back:
                there[slot, a], back[slot, b] = b, a
        return len({q for (p, q), slots in in_window.items() if all(there.get((s, a)) == b for s, a, b in slots)})


def _blocks(benchmark: DataFrame, item_id: str, text: str) -> list[Questions]:
    """The questions in blocks of bounded size; an item's texts stay together."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("text")).where("text IS NOT NULL")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // (5 * BLOCK)) or 1  # a token and its gap have five characters or so
    for i in range(n):
        part = rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == i).distinct().orderBy("item", "text").collect()
        if part:
            yield Questions([r["item"] for r in part], [r["text"] for r in part])


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def find_questions(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id, share): each document with each question that it holds.

    ``share`` is the part of the question's windows that one occurrence in the
    document holds with consistent slots, LEAST or more, in the reading that
    gives more.  Questions shorter than a window are one window.  Null and empty texts hold nothing and are
    no questions; exact repeats of a question count once, repeated document
    rows give repeated pairs.  Empty tables give no pairs; other columns play
    no part.  Whole texts are read, and no document is shuffled.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, share double"
    result = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark, item_id, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def find(batches, shared=shared):
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                found = [(d, i, s) for d, m in zip(ids, shared.value.matches(_texts(batch.column("text"))), strict=True) for i, s in m]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], kind) for i, kind in enumerate(
                    (pa.int64(), pa.int64(), pa.float64()))], names=["doc_id", "item_id", "share"])

        result = result.unionByName(source.mapInArrow(find, schema))
    return result


def without_questions(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no question, with exactly their own columns; nulls, repeats and the like as in find_questions."""
    for block in _blocks(benchmark, "item_id", "text"):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches, shared=shared):
            for batch in batches:
                found = shared.value.matches(_texts(batch.column(text)))
                yield batch.filter(pa.array([not m for m in found], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op2_decontamination(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_questions(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
