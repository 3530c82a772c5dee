"""Repeated passages, located by Aho-Corasick automata.

Every run of 50 words holds a sampled phrase (the one of the least hash), and
equal runs hold the same one.  Phrases that several documents have lead to the
runs that recur; these are joined to passages of the first document that has
them, and automata over the phrases of the passages are run over the documents
to find every occurrence, which is then confirmed word by word.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordsearch.llm import words
from recordsearch.llm.common import attach, checkpointed

#: Words of a run and of a phrase; characters of passages in one automaton; documents that one task runs through it.
RUN, PHRASE = 50, 12
SHARD_CHARS, TASK_DOCS = 1 << 21, 1000


def plain(text: str) -> bytes:
    """The words of a text, one space between them (bytes split at the blanks of a word's definition)."""
    return b" ".join(text.encode("utf-8", "surrogatepass").split())


def anchors(hashes: np.ndarray, run: int = RUN, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """For every run of words: hash and place of the phrase of the least hash in it (the first if equal)."""
    if len(hashes) < run:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    own = words.shingles(hashes, phrase)
    views = np.lib.stride_tricks.sliding_window_view(own, run - phrase + 1)
    step = max(1, (1 << 22) // views.shape[1])
    place = np.concatenate([views[i:i + step].argmin(axis=1) for i in range(0, len(views), step)]) + np.arange(len(views))
    return own[place], place


def _scan(run: int, phrase: int):
    """doc_id, digest of the words, their number, and the distinct sampled phrases of each text."""
    def scan(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            digests, counts, found = [], [], []
            for part in words.groups(texts):
                hashes, sizes = words.word_hashes(texts[part])
                for text, end, n in zip(texts[part], np.cumsum(sizes), sizes, strict=True):
                    digests.append(hashlib.sha256(plain(text)).hexdigest())
                    counts.append(int(n))
                    found.append(np.unique(anchors(hashes[end - n:end], run, phrase)[0]).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(digests, pa.string()), pa.array(counts, pa.int64()), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "digest", "n_words", "anchors"])
    return scan


def _packed(batches):
    """Texts compressed, as they are shuffled and stored several times."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = [packer.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "packed"])


def _open(packed: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass")


def _stretch_hashes(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of each stretch of words, from prefix sums of a polynomial modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    n = len(hashes)
    up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))
    down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64))))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1])))
    return words.mix((sums[starts + lengths] - sums[starts]) * down[starts] + lengths.astype(np.uint64), 29)


def _blocks(run: int, phrase: int):
    """Blocks of a document: neighbouring runs that share one place of a recurring phrase.

    doc_id, anchor, block (hash of all its words), start and n (its runs).
    Equal blocks of a document are one.
    """
    def blocks(batches):
        for batch in batches:
            for number, packed, known in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "anchors")), strict=True):
                hashes, _ = words.word_hashes([_open(packed)])
                own, place = anchors(hashes, run, phrase)
                at = np.flatnonzero(np.isin(own, np.array(known, np.int64).view(np.uint64)))
                if not len(at):
                    continue
                cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(place[at]) != 0)) + 1
                starts = at[np.concatenate(([0], cuts))]
                counts = np.diff(np.concatenate(([0], cuts, [len(at)])))
                value, first = np.unique(_stretch_hashes(hashes, starts, counts + run - 1), return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), number, np.int64)), pa.array(own[starts[first]].view(np.int64)), pa.array(value.view(np.int64)),
                     pa.array(starts[first]), pa.array(counts[first])], names=["doc_id", "anchor", "block", "start", "n"])
    return blocks


def _runs(run: int):
    """doc_id, place and hash of the distinct runs of the given blocks of a document."""
    def runs(batches):
        for batch in batches:
            for number, packed, blocks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "blocks")), strict=True):
                hashes, _ = words.word_hashes([_open(packed)])
                at = np.concatenate([np.arange(b["start"], b["start"] + b["n"]) for b in blocks])
                value, first = np.unique(_stretch_hashes(hashes, at, np.full(len(at), run)), return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), number, np.int64)), pa.array(at[first]), pa.array(value.view(np.int64))],
                    names=["doc_id", "start", "run"])
    return runs


def _passages(run: int):
    """Texts of the passages of a document from the runs that recur, given as start and number."""
    def cut(batches):
        for batch in batches:
            out = []
            for number, packed, parts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "packed", "parts")), strict=True):
                own = plain(_open(packed)).split(b" ")
                places = np.unique(np.concatenate([np.arange(b["start"], b["start"] + b["n"]) for b in parts]))
                ends = np.flatnonzero(np.diff(places) > 1)
                for a, b in zip(places[np.concatenate(([0], ends + 1))], places[np.concatenate((ends, [len(places) - 1]))], strict=True):
                    out.append((number, b" ".join(own[a:b + run]).decode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.string()))],
                                             names=["home", "passage"])
    return cut


class Automaton:
    """Passages of one shard; finds where a text repeats those of given homes."""

    def __init__(self, homes: list[int], passages: list[str], run: int = RUN, phrase: int = PHRASE):
        self.run, self.phrase = run, phrase
        self.hashes, self.machine = [], ahocorasick.Automaton()
        keys: dict[str, dict[int, list]] = {}
        for home, passage in zip(homes, passages, strict=True):
            number, own = len(self.hashes), passage.split(" ")
            self.hashes.append(words.word_hashes([passage])[0])
            for at in np.unique(anchors(self.hashes[-1], run, phrase)[1]).tolist():
                key = f" {' '.join(own[at:at + phrase])} "
                keys.setdefault(key, defaultdict(list))[home].append((number, at))
        for key, places in keys.items():
            self.machine.add_word(key, places)
        if keys:
            self.machine.make_automaton()

    def covered(self, text: str, homes: set[int]) -> np.ndarray:
        """For each word: is it in a run of equal words of a passage of these homes?"""
        own = f" {plain(text).decode('utf-8', 'surrogatepass')} "
        hashes, _ = words.word_hashes([text])
        marks = np.zeros(len(hashes) + 1, np.int64)
        if self.machine.kind != ahocorasick.AHOCORASICK:
            return np.zeros(len(hashes), dtype=bool)
        gaps = np.flatnonzero(np.frombuffer(own.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
        seen = set()
        for end, places in self.machine.iter(own):
            last = int(np.searchsorted(gaps, end))  # the phrase ends before this gap
            for home in homes & places.keys():
                for number, at in places[home]:
                    shift = last - self.phrase - at
                    if (number, shift) not in seen:
                        seen.add((number, shift))
                        self._mark(hashes, self.hashes[number], shift, marks)
        return np.cumsum(marks[:-1]) > 0

    def _mark(self, hashes: np.ndarray, passage: np.ndarray, shift: int, marks: np.ndarray) -> None:
        first, end = max(shift, 0), min(shift + len(passage), len(hashes))
        same = np.concatenate(([False], hashes[first:end] == passage[first - shift:end - shift], [False]))
        edges = np.flatnonzero(np.diff(same.view(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= self.run:
                marks[first + a] += 1
                marks[first + b] -= 1


def _spans(covered: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).view(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _kept(batches):
    for batch in batches:
        removed, digests = [], []
        for packed, spans in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            own = plain(_open(packed)).split(b" ")
            keep = np.ones(len(own), dtype=bool)
            for s in spans:
                keep[s["a"]:s["b"]] = False
            removed.append(int((~keep).sum()))
            digests.append(hashlib.sha256(b" ".join(w for w, k in zip(own, keep, strict=True) if k)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("digest"), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), batch.column("spans")],
            names=["doc_id", "digest", "n_removed", "kept_sha256", "spans"])


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, phrase: int = PHRASE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans (a, b: words from and to) of every row.

    A word is removed if it is covered by a run of ``run`` words whose
    sequence also starts in a document with a smaller id; runs are judged on
    the input.  All runs of all whole texts count.  A common passage makes
    rows in proportion to the documents that have it: first occurrences are
    found by partial aggregation, and the documents that run through one
    automaton are dealt to as many tasks as they need.

    Null and empty texts have no words (the digest is that of nothing).
    Texts under ``run`` words lose nothing.  Rows with a null id lose nothing
    and make no other row lose words.  Repeated rows have equal results and,
    with equal ids, do not count against each other; rows of one id with
    different texts are told apart.  An empty table gives no rows; other
    columns play no part.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scanned = checkpointed(source.mapInArrow(_scan(run, phrase), "doc_id long, digest string, n_words long, anchors array<long>"))
    each = scanned.where("doc_id IS NOT NULL").select("doc_id", F.explode("anchors").alias("anchor"))
    common = checkpointed(each.groupBy("anchor").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
        .where("first < last").select("anchor", F.lit(True).alias("recurs"), "n"))
    recurring = attach(each, common, "anchor", "doc_id", "n").where("recurs").groupBy("doc_id").agg(
        F.collect_set("anchor").alias("anchors"))
    packed = source.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_packed, "doc_id long, packed binary")
    texts = checkpointed(packed.join(recurring, "doc_id"))

    # blocks that are equal as a whole need no closer look
    blocks = checkpointed(texts.mapInArrow(_blocks(run, phrase), "doc_id long, anchor long, block long, start long, n long"))
    distinct = checkpointed(blocks.groupBy("block").agg(
        F.min("doc_id").alias("home"), F.min_by("start", "doc_id").alias("start"), F.max("doc_id").alias("last"),
        F.any_value("anchor").alias("anchor"), F.any_value("n").alias("n"), F.count("*").alias("members")))
    shared = distinct.where("home < last")
    by_block = attach(blocks.select("block", "doc_id"), shared.select("block", "home", "members"), "block", "doc_id", "members")

    # where one phrase is in different blocks, these may still have runs in common
    several = checkpointed(distinct.groupBy("anchor").agg(F.count("*").alias("variants")).where("variants > 1")
                           .select("anchor", F.lit(True).alias("several"), "variants"))
    asked = attach(distinct.select("anchor", F.col("home").alias("doc_id"), "start", "n", "block"), several, "anchor", "block", "variants")
    asked = asked.where("several").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("blocks"))
    runs = checkpointed(texts.select("doc_id", "packed").join(asked, "doc_id").mapInArrow(_runs(run), "doc_id long, start long, run long"))
    first = checkpointed(runs.groupBy("run").agg(
        F.min("doc_id").alias("home"), F.min_by("start", "doc_id").alias("start"), F.max("doc_id").alias("last"), F.count("*").alias("members"))
        .where("home < last").select("run", "home", "start", "members"))
    by_run = attach(runs.select("run", "doc_id"), first.select("run", "home", "members"), "run", "doc_id", "members")
    wanted = by_block.select("doc_id", "home").unionByName(by_run.select("doc_id", "home")).where("home < doc_id").distinct()

    parts = shared.select(F.col("home").alias("doc_id"), "start", "n").unionByName(
        first.select(F.col("home").alias("doc_id"), "start", F.lit(1).cast("long").alias("n")))
    parts = parts.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("parts"))
    passages = checkpointed(texts.select("doc_id", "packed").join(parts, "doc_id").mapInArrow(
        _passages(run), "home long, passage string").distinct())
    chars = passages.agg(F.sum(F.length("passage"))).first()[0] or 0
    shards = -(-chars // SHARD_CHARS) or 1
    shard = F.pmod(F.xxhash64("home"), F.lit(shards)).cast("int")
    asked = checkpointed(wanted.groupBy("doc_id", shard.alias("shard")).agg(F.collect_set("home").alias("homes")))
    sizes = checkpointed(asked.groupBy("shard").agg(F.count("*").alias("n"))).withColumn(
        "tasks", F.ceil(F.col("n") / TASK_DOCS).cast("int"))
    dealt = attach(asked, sizes, "shard", "doc_id", "n").withColumn(
        "task", F.pmod(F.xxhash64("doc_id", F.lit("task")), F.col("tasks")).cast("int"))
    left = dealt.select("doc_id", "shard", "task", "homes").join(texts.select("doc_id", "packed"), "doc_id")
    right = (passages.withColumn("shard", shard).join(sizes.select("shard", "tasks"), "shard")
             .select("shard", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "home", "passage"))

    def locate(documents: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        machine = Automaton(known["home"].tolist(), known["passage"].tolist(), run, phrase)
        out = []
        for number, packed_text, own in documents[["doc_id", "packed", "homes"]].itertuples(index=False, name=None):
            content = _open(packed_text)
            spans = _spans(machine.covered(content, set(own)))
            digest = hashlib.sha256(plain(content)).hexdigest()
            out += [(number, digest, a, b) for a, b in spans]
        return pd.DataFrame(out, columns=["doc_id", "digest", "a", "b"]).astype({"doc_id": "int64", "digest": "str", "a": "int64", "b": "int64"})

    spans = left.groupBy("shard", "task").cogroup(right.groupBy("shard", "task")).applyInPandas(
        locate, "doc_id long, digest string, a long, b long")
    spans = spans.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))
    changed = checkpointed(spans).withColumnRenamed("digest", "_digest")
    cut = texts.select("doc_id", "packed").join(changed, "doc_id").withColumnRenamed("_digest", "digest").mapInArrow(
        _kept_of_row, "doc_id long, digest string, n_removed long, kept_sha256 string, spans array<struct<a:long,b:long>>"
    ).dropDuplicates(["doc_id", "digest"])
    base = scanned.select("doc_id", "digest", "n_words")
    result = base.join(cut, ["doc_id", "digest"], "left")
    return result.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
                         F.coalesce("kept_sha256", "digest").alias("kept_sha256"), "spans")


def _kept_of_row(batches):
    """Kept words of the rows whose text is the one that the spans were found in."""
    for batch in batches:
        own = [hashlib.sha256(plain(_open(t))).hexdigest() for t in batch.column("packed").to_pylist()]
        same = pa.array([a == b for a, b in zip(own, batch.column("digest").to_pylist(), strict=True)], pa.bool_())
        yield from _kept([batch.filter(same)])


def op5_repeated_passages(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeated_passages(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
