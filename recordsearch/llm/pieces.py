"""Encoding into pieces and back, by the last piece of every prefix.

Merging always takes the neighbours whose union has the best score (the
leftmost of equals), so a text's pieces, cut off behind any of them, are the
pieces of the text up to there.  The last piece of a prefix is therefore the
one piece ending there that is compatible with the last piece of the prefix
before it, and the whole encoding is read off backwards.  Two pieces are
compatible if merging the text of both gives just the two.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: The sign of a blank.
BLANK = "▁"
#: Segments that a worker remembers, the most characters of one, and the pairs of pieces it remembers.
SEGMENTS, LONGEST, PAIRS = 1 << 19, 64, 1 << 19
#: Characters (or ids) of the rows that leave a task together; a larger row goes alone.
GROUP = 1 << 20


class Merges:
    """Scores of pieces, what they grow from, and which may stand side by side."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self._grown: dict[str, list | None] = {}

    def merged(self, text: str) -> tuple[list[str], list]:
        """Pieces of a short text by merging, and of each merge its score and the outer pieces behind it."""
        parts, steps = list(text), []
        while len(parts) > 1:
            options = [(score, -i) for i in range(len(parts) - 1)
                       if (score := self.scores.get(parts[i] + parts[i + 1])) is not None]
            if not options:
                break
            score, at = max(options)
            parts[-at:2 - at] = [parts[-at] + parts[1 - at]]
            steps.append((score, parts[0], parts[-1]))
        return parts, steps

    def grown(self, piece: str) -> list | None:
        """The merges that make a piece; None if merging its text ends in something else."""
        found = self._grown.get(piece, self)
        if found is self:
            parts, steps = self.merged(piece)
            found = self._grown[piece] = steps if len(parts) == 1 else None
        return found

    def compatible(self, one: str, other: str) -> bool:
        """Whether no merge over the border comes first while both pieces grow, best merge first."""
        left, right = self.grown(one), self.grown(other)
        if left is None or right is None:
            return False
        edge, start = one[-1], other[0]
        i = j = 0
        while True:
            over = self.scores.get(edge + start)
            a = left[i][0] if i < len(left) else -np.inf
            b = right[j][0] if j < len(right) else -np.inf
            if over is not None and over > a and over >= b:  # of equals the leftmost merge comes first
                return False
            if i == len(left) and j == len(right):
                return True
            if j == len(right) or (i < len(left) and a >= b):
                edge, i = left[i][2], i + 1
            else:
                start, j = right[j][1], j + 1


class Encoder(dict):
    """Ids of texts under a model of merges with byte fallback; remembers the ids of short segments, packed."""

    def __init__(self, model: bytes):
        own = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(own.get_piece_size())
        special = {i for i in every if own.is_control(i) or own.is_unknown(i)}
        self.pieces = {own.id_to_piece(i): i for i in every if not (i in special or own.is_byte(i) or own.is_unused(i))}
        self.bytes = [own.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not own.is_byte(i) for i in self.bytes):
            raise ValueError("the model has no pieces for single bytes")
        if own.normalize("  x Åﬁ ") != f"{BLANK * 3}x{BLANK}Åﬁ{BLANK}":
            raise ValueError("the model changes its texts by more than the sign for blanks and one blank in front")
        self.library = own
        # what an id says, in bytes; the library decodes where a special one occurs
        self.said = [None if i in special else own.id_to_piece(i).replace(BLANK, " ").encode() for i in every]
        for b, i in enumerate(self.bytes):
            self.said[i] = bytes([b])
        self.prepare(Merges({p: own.get_score(i) for p, i in self.pieces.items() if len(p) > 1}))

    def prepare(self, merges: Merges) -> None:
        """The automaton of the pieces, and how texts fall into segments."""
        self.merges, self.pairs = merges, {}
        self.machine = ahocorasick.Automaton()
        for piece in merges.scores:
            self.machine.add_word(piece, (len(piece), piece))
        self.machine.make_automaton()
        # no piece goes on over a blank or holds any but these letters, so texts fall into segments
        letters = re.escape("".join(sorted({c for p in merges.scores for c in p} - {BLANK})))
        inner = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in merges.scores)
        self.segments = None if inner or not letters else re.compile(
            f"{BLANK}+[{letters}]*|[{letters}]+|.", re.DOTALL).findall

    def __missing__(self, segment: str) -> bytes:
        packed = array("i", self.ids_of(segment)).tobytes()
        if len(segment) <= LONGEST:
            if len(self) >= SEGMENTS:
                self.clear()
            self[segment] = packed
        return packed

    def last_pieces(self, text: str) -> list[str | None]:
        """By the place of its last character, the last piece of every prefix; None stands for that character alone."""
        last: list[str | None] = [None] * len(text)
        if len(text) < 2 or not len(self.machine):
            return last
        known, grown = self.pairs, self.merges.grown
        for end, (size, piece) in self.machine.iter(text):  # by ends, so all prefixes before are settled
            if last[end] is None:
                before = end - size
                if before >= 0:
                    pair = (last[before] or text[before], piece)
                    fits = known.get(pair)
                    if fits is None:
                        if len(known) >= PAIRS:
                            known.clear()
                        fits = known[pair] = self.merges.compatible(*pair)
                    if fits:
                        last[end] = piece
                elif grown(piece) is not None:
                    last[end] = piece
        return last

    def ids_of(self, text: str) -> list[int]:
        """Ids of a segment, read off its table backwards."""
        last, end, found, own = self.last_pieces(text), len(text) - 1, [], self.pieces
        while end >= 0:
            piece = last[end] or text[end]
            if piece in own:
                found.append(own[piece])
            else:
                found += [self.bytes[b] for b in reversed(piece.encode())]
            end -= len(piece)
        found.reverse()
        return found

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.zeros(0, np.int32)
        marked = BLANK + text.replace(" ", BLANK)
        found = self.segments(marked) if self.segments else [marked]
        return np.frombuffer(b"".join(map(self.__getitem__, found)), np.int32)

    def text(self, ids: list[int] | None) -> str:
        """The text of ids: what they say, without the blank in front."""
        if not ids:
            return ""
        try:
            text = b"".join(map(self.said.__getitem__, ids)).decode()
        except (TypeError, UnicodeDecodeError):  # special ids, or bytes that are no text
            return self.library.decode(ids)
        return text[1:] if self.said[ids[0]][0] == 32 and ids[0] != self.bytes[32] else text


@lru_cache(maxsize=1)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)  # once a worker, not once a task


def _runs(sizes: np.ndarray) -> list[slice]:
    """Runs of neighbouring rows of at most about GROUP of size together."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // GROUP)) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    return [slice(a, b) for a, b in zip(edges, edges[1:]) if a < b]


def _mapped(df: DataFrame, value: str, out: list[StructField], keep: tuple[str, ...], model: bytes, sizes, convert) -> DataFrame:
    """``keep`` and columns that ``convert(encoder, values)`` makes as Arrow arrays, a bounded run of rows at a time."""
    schema = StructType([*(df.schema[c] for c in keep), *out])
    shared = df.sparkSession.sparkContext.broadcast(model)  # the file of a vocabulary, not data

    def run(batches):
        encoder = _encoder(shared.value)
        for batch in batches:
            values = batch.column(len(keep))
            for part in _runs(pc.fill_null(sizes(values), 0).to_numpy(zero_copy_only=False) + 64):
                kept = [batch.column(i)[part] for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, *convert(encoder, values[part].to_pylist())], names=schema.names)

    named = [F.col(c).alias(f"_{i}") for i, c in enumerate([*keep, value])]
    return df.select(*named).mapInArrow(run, schema)


def encode(docs: DataFrame, model: bytes, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "ids",
           decoded: str | None = None) -> DataFrame:
    """The columns ``keep`` and the ids of every whole text, without begin and end ids.

    With ``decoded`` a column of that name has the text that the ids decode
    to, from the same task.  ``model`` is the file of a vocabulary of merges
    with pieces for single bytes that leaves texts as they are (else an error
    is raised).  Rows are independent: nothing is shuffled, repeated rows and
    ids are encoded each, the order does not matter, an empty table gives no
    rows.  Null and empty texts have no ids.  A text without blanks, however
    long, is one segment with work and memory in proportion to its length.
    Other columns play no part, whatever their names.
    """
    def convert(encoder: Encoder, texts: list) -> list[pa.Array]:
        found = [encoder.ids(t) for t in texts]
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *found])))
        return [listed] if decoded is None else [listed, pa.array([encoder.text(f.tolist()) for f in found], pa.string())]

    fields = [StructField(out, ArrayType(IntegerType(), False))] + ([StructField(decoded, StringType())] if decoded else [])
    return _mapped(docs, text, fields, keep, model, pc.utf8_length, convert)


def decode(rows: DataFrame, model: bytes, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",), out: str = "text") -> DataFrame:
    """The columns ``keep`` and the text of every list of ids; null and empty lists give an empty text."""
    def convert(encoder: Encoder, lists: list) -> list[pa.Array]:
        return [pa.array([encoder.text(i) for i in lists], pa.string())]

    return _mapped(rows, ids, [StructField(out, StringType())], keep, model, pc.list_value_length, convert)


def op12_piece_ids(spark, sf_dir, model_file: str | None = None) -> DataFrame:
    import public_tokenizers

    with open(model_file or public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    tokens = encode(docs, model, decoded="again")
    return tokens.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                         F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("again", 256).alias("decoded_sha256"))
