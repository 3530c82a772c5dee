"""Near duplicates by Order MinHash, verified by banded alignment.

A text is a sequence of shingles of five words, each labelled with its number
of occurrence.  A sketch holds the few least shingles under one hash function
in text order, so equal sketches mean common shingles in a common order.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordsearch.llm import words
from recordsearch.llm.common import attach, fresh
from recordsearch.llm.graph import components

#: Words of a shingle; least similarity; sketches of a text; shingles of a sketch.
SHINGLE, SIMILAR, SKETCHES, KEPT = 5, 0.8, 16, 3

_WIDE = 1 << 16
#: Most bits of a labelled shingle that name its counter.
_SLOT_BITS = 22
#: Rows of one shingle in one part of the join.
_SHARE = 1 << 12
#: Aligned shingles of a pair at the least similarity, as a part of the shingles of both.
_BOTH = SIMILAR / (1 + SIMILAR)


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    base = words.mix(np.arange(1, 2 * SKETCHES + 1, dtype=np.uint64), 17)
    return base[:SKETCHES, None], base[SKETCHES:, None] | np.uint64(1)


_XOR, _ODD = _seeds()


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Each shingle mixed with how often it occurred before, so that all are distinct."""
    order = np.argsort(shingles, kind="stable")
    same = shingles[order]
    place = np.arange(len(order))
    first = np.ones(len(order), dtype=bool)
    first[1:] = same[1:] != same[:-1]
    number = np.empty(len(order), np.uint64)
    number[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return words.mix(shingles + number * np.uint64(0x9E3779B97F4A7C15), 23)


def sketches(shingles: np.ndarray) -> np.ndarray:
    """Order MinHash: a key for each hash function, from the KEPT least labelled shingles in text order."""
    own = labelled(shingles)
    kept = min(KEPT, len(own))
    keys = np.zeros(SKETCHES, np.uint64)
    step = max(1, min(SKETCHES, _WIDE * SKETCHES // max(len(own), 1)))
    for start in range(0, SKETCHES, step):  # long texts take the functions a few at a time
        rows = slice(start, start + step)
        value = (own ^ _XOR[rows]) * _ODD[rows]
        value = (value ^ (value >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        least = np.argpartition(value, kept - 1, axis=1)[:, :kept]
        chosen = own[np.sort(least, axis=1)]
        key = np.zeros(len(chosen), np.uint64)
        for i in range(kept):
            key = key * np.uint64(0x9E3779B97F4A7C15) + chosen[:, i]
        keys[rows] = words.mix(key + _XOR[rows, 0])
    return keys


def _increasing(values: np.ndarray) -> int:
    """Length of a longest increasing subsequence."""
    if not len(values) or (np.diff(values) > 0).all():
        return len(values)
    tails: list[int] = []
    for v in values.tolist():
        at = bisect.bisect_left(tails, v)
        tails[at:at + 1] = [v]
    return len(tails)


def similarity(one: np.ndarray, other: np.ndarray, least: float = SIMILAR) -> float:
    """Aligned shingles over all shingles: m / (a + b - m); 0 if below ``least``.

    m is the length of the longest common subsequence of the labelled
    shingles.  A pair that reaches ``least`` has at most (1 - least) /
    (1 + least) of its a + b shingles unaligned, so aligned places differ by
    that much at most: only this band is looked at.
    """
    a, b = len(one), len(other)
    needed = least * (a + b) / (1 + least)
    if min(a, b) < needed or not needed:
        return 0.0
    _, at, to = np.intersect1d(labelled(one), labelled(other), assume_unique=True, return_indices=True)
    band = (1 - least) / (1 + least) * (a + b)
    near = np.abs(at - to) <= band + 1e-9
    at, to = at[near], to[near]
    if len(at) < needed - 1e-9:
        return 0.0
    m = _increasing(to[np.argsort(at)])
    share = m / (a + b - m)
    return share if share >= least - 1e-12 else 0.0


def text_digest(text: Column) -> Column:
    """Equal for texts with the same words in the same order; null without words."""
    plain = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.when(F.length(plain) > 0, F.md5(plain.cast("binary")))


def _pack(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    three = np.frombuffer(packed, np.uint8).reshape(-1, 3)
    four = np.zeros((len(three), 4), np.uint8)
    four[:, :3] = three
    return words.shingles(words.mix(four.view("<u4")[:, 0].astype(np.uint64), 5), SHINGLE)


def _per_text(batches, make):
    """One arrow batch per input batch: doc_id, digest and what ``make`` gives for the words of each text."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        out = []
        for part in words.groups(texts):
            hashes, sizes = words.word_hashes(texts[part])
            ends = np.cumsum(sizes)
            out += [make(hashes[e - n:e]) for e, n in zip(ends, sizes, strict=True)]
        yield [batch.column("doc_id"), batch.column("digest")], out


def _sketch(batches):
    for ids, found in _per_text(batches, lambda w: words.shingles(w, SHINGLE)):
        keys = [sketches(s).view(np.int64).tolist() if len(s) else [] for s in found]
        yield pa.RecordBatch.from_arrays([*ids, pa.array([len(s) for s in found], pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                                         names=["doc_id", "digest", "n", "keys"])


def _sequences(batches):
    for ids, found in _per_text(batches, _pack):
        yield pa.RecordBatch.from_arrays([*ids, pa.array(found, pa.binary())], names=["first_id", "node", "words"])


def _verify(batches):
    for batch in batches:
        one, other = batch.column("left_words").to_pylist(), batch.column("right_words").to_pylist()
        share = [similarity(_unpack(x), _unpack(y)) for x, y in zip(one, other, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("lead"), batch.column("node"), pa.array(share, pa.float64())],
                                         names=["lead", "node", "share"])


def _slots(bits: int):
    """Tasks that count the labelled shingles of their rows in 2^bits counters."""
    def count(batches):
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for packed in batch.column("words").to_pylist():
                slot, n = np.unique(_slot(labelled(_unpack(packed)), bits), return_counts=True)
                total[slot] += n
        slot = np.flatnonzero(total)
        for part in np.array_split(slot, len(slot) // _WIDE + 1):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(total[part])], names=["slot", "n"])

    return count


def _slot(own: np.ndarray, bits: int) -> np.ndarray:
    return (own >> np.uint64(64 - bits)).astype(np.int64)


def rare_first(own: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """The labelled shingles that a similar text must share one of: the rarest, in one order for all texts.

    ``rarity`` is a table of 2^b classes of rarity, found by the top b bits.
    """
    order = np.lexsort((own, rarity[_slot(own, len(rarity).bit_length() - 1)]))
    return own[order[:len(own) - int(np.ceil(SIMILAR * len(own) - 1e-9)) + 1]]


def _rarity(crowd: DataFrame) -> np.ndarray:
    """Classes of rarity (the binary logarithm of a count in eighths) of the crowd's shingles, one byte a counter.

    There are as many counters as a few of the crowd's shingles need, 2^22 at
    most: what the driver holds is bounded by 4 MB and small for a small crowd.
    Shingles that share a counter cost comparisons, never a pair.
    """
    words_of = crowd.agg(F.coalesce(F.sum(F.length("words") / 3), F.lit(0)).cast("long").alias("n")).first()["n"]
    bits = min(max(int(2 * words_of).bit_length(), 8), _SLOT_BITS)
    counts = crowd.select("words").mapInArrow(_slots(bits), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    found = counts.select("slot", F.least(F.lit(255), F.round(8 * F.log2(F.col("n") + 1))).cast("short").alias("rarity")).toArrow()
    table = np.zeros(1 << bits, np.uint8)
    table[found.column("slot").to_numpy()] = found.column("rarity").to_numpy()
    return table


def _crowd_pairs(crowd: DataFrame) -> DataFrame:
    """(lead, node): all pairs of a crowd (node, root, words) with different roots that can reach SIMILAR.

    Exact, by prefix filtering: a pair at SIMILAR has, in any common order of
    the shingles, its first common shingle among the first 1 - SIMILAR of each
    text, and behind it enough shingles in both.  The order is by counts in the
    crowd, so what fills a bucket (a template) comes last.  A shingle of many
    rows and classes is dealt over parts by its rows' ids.
    """
    shared = crowd.sparkSession.sparkContext.broadcast(_rarity(crowd))

    def prefixes(batches):
        for batch in batches:
            own = [labelled(_unpack(w)) for w in batch.column("words").to_pylist()]
            chosen = [rare_first(o, shared.value).view(np.int64).tolist() for o in own]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("class"), pa.array([len(o) for o in own], pa.int64()),
                                              pa.array(chosen, pa.list_(pa.int64()))], names=["id", "class", "n", "chosen"])

    named = crowd.select(F.xxhash64("node").alias("id"), F.xxhash64("root").alias("class"), "node", "words")
    rows = fresh(named.select("id", "class", "words").mapInArrow(prefixes, "id long, class long, n long, chosen array<long>")
                  .select("id", "class", "n", F.posexplode("chosen").alias("place", "shingle")))
    met = rows.groupBy("shingle").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.count("*").alias("k"))
    met = met.where("a <> b").select("shingle", F.ceil(F.col("k") / _SHARE).cast("int").alias("parts"))
    rows = fresh(rows.join(met, "shingle"))
    # the longer text of a pair is at most 1 / SIMILAR as long: of three neighbouring steps of that ratio one is its own
    step = F.floor(F.log("n") / float(-np.log(SIMILAR))).cast("int")
    # the shorter one has the shingle among its first 1 - 2 SIMILAR / (1 + SIMILAR)
    short = rows.where(F.col("n") - F.col("place") >= 2 * _BOTH * F.col("n") - 1e-9).withColumns(
        {"part": F.pmod(F.col("id"), F.col("parts")).cast("int"), "step": F.explode(F.sequence(step, step + 2))})
    long = rows.withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "step": step})
    both = short.alias("y").join(long.alias("x"), F.expr(
        "x.shingle = y.shingle AND x.part = y.part AND x.step = y.step AND x.class <> y.class AND (y.n, y.id) < (x.n, x.id)")
        & (F.col("y.n") >= SIMILAR * F.col("x.n") - 1e-9)
        & (F.least(F.expr("x.n - x.place"), F.expr("y.n - y.place")) >= _BOTH * F.expr("x.n + y.n") - 1e-9))
    pairs = both.select(F.col("y.id").alias("y"), F.col("x.id").alias("x")).distinct()
    ids = named.select("id", "node")
    return pairs.join(ids.select(F.col("id").alias("y"), F.col("node").alias("lead")), "y").join(
        ids.select(F.col("id").alias("x"), "node"), "x").select("lead", "node")


def _candidates(buckets: DataFrame) -> DataFrame:
    """(key, lead, node): every member of a bucket with the member of the smallest id."""
    leads = fresh(buckets.groupBy("key").agg(
        F.min(F.struct("first_id", "node", "n")).alias("least"), F.count("*").alias("members")).where("members > 1")
        .select("key", F.col("least.node").alias("lead"), F.col("least.n").alias("lead_n"), "members"))
    return attach(buckets, leads, "key", "node", "members").where("lead IS NOT NULL AND lead <> node")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, root and class_id of every row; class_id is the smallest id of its class.

    ``root`` names the class even where ids are repeated or null.  Classes are the connected components of links; a link is a pair of
    different texts with a similarity of 0.8 or more, and texts with the same
    words are one node from the start, however many copies there are.

    Texts with an equal sketch meet in a bucket.  There each is compared with
    the member of the smallest id, and those it rejects with the smallest of
    the rejected and with one that was accepted.  The members of buckets that
    are not one class by then (thousands of texts on one template, say) are
    compared in full: with all texts of these buckets that an exact filter on
    rare shingles leaves.  With 16 sketches of 3 shingles, texts at the least
    similarity miss each other with a probability of about
    (1 - 0.8^3)^16 = 0.001 %: that of having no bucket in common.

    Texts with fewer than five words are one shingle.  Rows whose text is
    null or has no words are a class each, with their own id.  Repeated rows
    are copies.  Null ids: such rows take part, a class of only such rows has
    class null.  Equal ids with different texts are told apart by digest.  An
    empty table gives no rows; other columns play no part.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
                         text_digest(F.col(text)).alias("digest"))
    sketched = fresh(source.mapInArrow(_sketch, "doc_id long, digest string, n long, keys array<long>"))
    nodes = fresh(sketched.where("digest IS NOT NULL").groupBy(F.col("digest").alias("node")).agg(
        F.min("doc_id").alias("first_id"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), F.count("*").alias("copies")))
    buckets = nodes.select("node", "first_id", "n", F.explode("keys").alias("key"))
    fit = (F.least("n", "lead_n") >= SIMILAR * F.greatest("n", "lead_n") - 1e-9)
    first = fresh(_candidates(buckets).select("key", "node", "first_id", "n", "lead", "lead_n"))
    pairs = fresh(first.where(fit).select("lead", "node").distinct())
    needed = pairs.select("node").unionByName(pairs.select(F.col("lead").alias("node"))).distinct()
    # the second round compares only members of the same buckets
    needed = needed.unionByName(first.where(~fit).select("node")).distinct()
    needed = nodes.select("node", "first_id").join(needed, "node", "left_semi")
    own = source.where("digest IS NOT NULL").mapInArrow(_sequences, "first_id long, node string, words binary")
    texts = fresh(  # of each node the row with its smallest id, so copies are spread by their ids
        own.alias("o").join(needed.alias("q"), F.expr("o.node = q.node AND o.first_id <=> q.first_id"))
        .select("o.node", "o.first_id", "o.words").dropDuplicates(["node", "first_id"]).select("node", "words"))

    def verified(asked: DataFrame) -> DataFrame:
        right = texts.withColumnRenamed("words", "right_words")
        left = texts.select(F.col("node").alias("lead"), F.col("words").alias("left_words"))
        both = asked.join(right, "node").join(left, "lead")
        return fresh(both.mapInArrow(_verify, "lead string, node string, share double"))

    checked = verified(pairs)
    links = checked.where("share > 0").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    judged = first.join(checked, ["lead", "node"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    judged = fresh(judged.select("key", "node", "first_id", "n", "share"))
    rejected = judged.where("share = 0").drop("share")
    again = _candidates(rejected).select("lead", "node", "n", "lead_n")
    accepted = fresh(judged.where("share > 0").groupBy("key").agg(
        F.max(F.struct("first_id", "node", "n")).alias("last"))
        .join(rejected.groupBy("key").agg(F.count("*").alias("members")), "key")
        .select("key", F.col("last.node").alias("lead"), F.col("last.n").alias("lead_n"), "members"))
    beside = attach(rejected, accepted, "key", "node", "members").where("lead IS NOT NULL").select("lead", "node", "n", "lead_n")
    second = again.unionByName(beside).where(fit).select("lead", "node").distinct().join(
        checked.select("lead", "node"), ["lead", "node"], "left_anti")
    links = links.unionByName(verified(second).where("share > 0").select(F.col("lead").alias("a"), F.col("node").alias("b")))

    roots = fresh(components(links))
    member = fresh(judged.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    open_ = member.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("members")).where(
        "a <> b AND members > 2")  # of two, each was compared with the other
    asked = attach(member, fresh(open_.select("key", "a", "members")), "key", "node", "members").where("a IS NOT NULL")
    crowd = fresh(texts.join(asked.select("node", "root").distinct(), "node").select("node", "root", "words"))
    late = verified(_crowd_pairs(crowd)).where("share > 0").select("lead", "node")
    of = crowd.select("node", "root")
    joined = components(late.join(of.withColumnRenamed("root", "b"), "node").join(
        of.select(F.col("node").alias("lead"), F.col("root").alias("a")), "lead").select("a", "b"))
    rooted = nodes.select("node", "first_id", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = fresh(rooted.join(joined.select(F.col("node").alias("root"), F.col("root").alias("last")), "root", "left")
                          .withColumn("root", F.coalesce("last", "root")).drop("last"))
    classes = fresh(rooted.groupBy("root").agg(F.min("first_id").alias("class_id"), F.count("*").alias("members")))
    named = fresh(attach(rooted, classes, "root", "node", "members").select(
        F.col("node").alias("digest"), "class_id", "root", "copies"))
    rows = attach(sketched.select("doc_id", "digest"), named, "digest", "doc_id", "copies")
    return rows.withColumn("class_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id")))


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each class: the one with the smallest id; rows without words stay."""
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))
    stay = near_duplicates(docs).where("digest IS NOT NULL").groupBy("root").agg(
        F.min(F.struct(own_id.alias("_id"), F.col("digest").alias("_digest"))).alias("s")).select("s.*")
    own = docs.withColumns({"_digest": text_digest(F.col("text")), "_id": own_id})
    order = Window.partitionBy("_id", "_digest").orderBy(*[c for c in ("source", "lang", "n_chars") if c in docs.columns], F.lit(1))
    kept = (own.where("_digest IS NOT NULL").join(stay, ["_id", "_digest"])
            .withColumn("_n", F.row_number().over(order)).where("_n = 1"))
    return kept.select(*docs.columns).unionByName(own.where("_digest IS NULL").select(*docs.columns))


def op9_near_duplicates(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id")
