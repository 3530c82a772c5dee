"""Text clean-up and analysis as native Columns.

Analysed text has one form everywhere: the tokens in order, each between its
own pair of blanks (" a  b  a ").  Word, phrase and prefix tests on that form
are plain substring tests and counts, so they stay inside generated code and
need no shuffle and no array of tokens.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from recordsearch.functions import portuguese

WORD_CHARS = r"\p{L}\p{N}"
TOKEN_PATTERN = rf"[{WORD_CHARS}]+"
# Keeps numbers with inner dots or commas, such as 000.000.000, in one piece.
STANDARD_TOKEN_PATTERN = r"\p{N}+(?:[.,]\p{N}+)+|[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Analysis:
    """How text becomes tokens.

    ``stopwords`` are left out and ``suffixes`` are cut from word ends (the
    longest one that leaves ``min_stem`` letters).  Both are empty for the
    exact analysis, which only lower-cases.  ``language`` (portuguese) stems
    by the rules of that language instead.
    """

    token_pattern: str = TOKEN_PATTERN
    stopwords: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()
    min_stem: int = 3
    language: str = ""

    def _suffix_alternatives(self) -> str:
        longest_first = sorted(self.suffixes, key=lambda s: (-len(s), s))
        return "|".join(regex.escape(s) for s in longest_first)

    def stem(self, token: Column) -> Column:
        if self.language:
            return portuguese.stem(token)
        if not self.suffixes:
            return token
        return F.regexp_replace(
            token, rf"^(.{{{self.min_stem},}}?)(?:{self._suffix_alternatives()})$", "$1"
        )

    def tokens(self, text: Column) -> Column:
        """Array of the analysed tokens, in text order."""
        found = F.regexp_extract_all(F.lower(text), F.lit(self.token_pattern), F.lit(0))
        if self.stopwords:
            found = F.filter(found, lambda t: ~t.isin(*self.stopwords))
        if self.suffixes or self.language:
            found = F.transform(found, self.stem)
        return found

    def unstemmed(self) -> Analysis:
        """The same without stems: what a vocabulary is made of before its words are stemmed once each."""
        return replace(self, suffixes=(), language="")

    def spaced(self, text: Column) -> Column:
        """The tokens as one string, each between its own two blanks."""
        if self.token_pattern != TOKEN_PATTERN or self.language:
            body = F.array_join(self.tokens(text), "  ")
            return F.concat(F.lit(" "), body, F.lit(" "))
        body = F.trim(F.regexp_replace(F.lower(text), rf"[^{WORD_CHARS}]+", "  "))
        out = F.concat(F.lit(" "), body, F.lit(" "))
        if self.stopwords:
            words = "|".join(regex.escape(w) for w in self.stopwords)
            out = F.regexp_replace(out, f" (?:{words}) ", "")
        if self.suffixes:
            out = F.regexp_replace(
                out,
                rf"(?<= )([^ ]{{{self.min_stem},}}?)(?:{self._suffix_alternatives()})(?= )",
                "$1",
            )
        return out

    def words(self, text: str) -> list[str]:
        """Analyse a short query text on the driver, by the same rules."""
        found = regex.findall(self.token_pattern, text.lower())
        found = [t for t in found if t not in self.stopwords]
        if self.language:
            return [portuguese.stem_text(t) for t in found]
        if self.suffixes:
            rule = regex.compile(
                rf"^(.{{{self.min_stem},}}?)(?:{self._suffix_alternatives()})$"
            )
            found = [rule.sub(r"\1", t) for t in found]
        return found


EXACT = Analysis()


def portuguese_analysis() -> Analysis:
    """Language analysis for Portuguese: the stop-words that Spark ships and stems by rules."""
    from pyspark.ml.feature import StopWordsRemover

    return Analysis(stopwords=tuple(StopWordsRemover.loadDefaultStopWords("portuguese")), language="portuguese")


def let(value: Column, body) -> Column:
    """Bind a value once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


CHUNK = 32
LOCATED = "array<struct<token:string,start:int,stop:int>>"


def token_runs(text: Column, token_pattern: str = TOKEN_PATTERN) -> Column:
    """Raw tokens in runs of CHUNK: array of (first, begin, tokens, gaps).

    ``first`` is the number of the run's first token, ``begin`` the place in
    the text where the gap before it starts; ``gaps`` stand before the tokens
    (after the last token of the text there may be one more).
    """
    found = F.struct(F.split(text, token_pattern).alias("gaps"),
                     F.regexp_extract_all(text, F.lit(token_pattern), F.lit(0)).alias("tokens"))

    def runs(all_found):
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(all_found["tokens"]) - 1, F.lit(0)), F.lit(CHUNK)),
            lambda at: F.struct(at.alias("first"), F.slice(all_found["tokens"], at + 1, CHUNK).alias("tokens"),
                                F.slice(all_found["gaps"], at + 1, CHUNK).alias("gaps")))

    def step(done, run):
        width = F.length(F.array_join(run["gaps"], "")) + F.length(F.array_join(run["tokens"], ""))
        return F.struct((done["at"] + width).alias("at"),
                        F.concat(done["begins"], F.array(done["at"])).alias("begins"))

    def with_begins(parts):
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins"))
        begins = F.aggregate(parts, first, step, lambda done: done["begins"])
        return F.zip_with(parts, begins, lambda run, begin: F.struct(
            run["first"].alias("first"), begin.alias("begin"), run["tokens"].alias("tokens"), run["gaps"].alias("gaps")))

    return let(found, lambda all_found: F.when(text.isNotNull(), let(runs(all_found), with_begins)))


def token_stops(begin: Column, tokens: Column, gaps: Column) -> Column:
    """Where each token of a run ends: running sums over the gaps and tokens."""
    sums = F.aggregate(F.arrays_zip(gaps.alias("gap"), tokens.alias("tok")), F.array(begin), lambda done, pair: F.concat(
        done, F.array(F.element_at(done, -1) + F.length(pair["gap"]) + F.length(pair["tok"]))))
    return F.slice(sums, F.lit(2), F.size(tokens))


def located_tokens(text: Column, token_pattern: str = TOKEN_PATTERN) -> Column:
    """Every raw token with its 0-based place: array of (token, start, stop).

    The places are running sums over the tokens and the gaps between them.
    They are summed in chunks, so the work grows with the length of the text
    and not with its square.
    """
    found = F.regexp_extract_all(text, F.lit(token_pattern), F.lit(0))
    pairs = F.zip_with(
        F.split(text, token_pattern), found,
        lambda gap, tok: F.struct(F.length(gap).alias("gap"), tok.alias("tok")),
    )

    def places(begin, chunk):
        def step(state, pair):
            start = state["at"] + pair["gap"]
            stop = start + F.length(pair["tok"])
            here = F.struct(pair["tok"].alias("token"), start.alias("start"), stop.alias("stop"))
            return F.struct(stop.alias("at"), F.concat(state["out"], F.array(here)).alias("out"))

        empty = F.array().cast(LOCATED)
        first = F.struct(begin.alias("at"), empty.alias("out"))
        return F.aggregate(chunk, first, step, lambda state: state["out"])

    def by_chunks(all_pairs):
        # The last piece of the split has no token after it.
        chunks = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(all_pairs) - 2, F.lit(0)), F.lit(CHUNK)),
            lambda at: F.filter(F.slice(all_pairs, at + 1, CHUNK), lambda p: p["tok"].isNotNull()),
        )

        def step(done, chunk):
            width = F.aggregate(
                chunk, F.lit(0), lambda total, p: total + p["gap"] + F.length(p["tok"])
            )
            row = F.struct(
                (done["at"] + width).alias("at"),
                F.concat(done["begins"], F.array(done["at"])).alias("begins"),
            )
            return row

        def with_begins(parts):
            first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins"))
            begins = F.aggregate(parts, first, step, lambda done: done["begins"])
            return F.flatten(F.zip_with(begins, parts, places))

        return let(chunks, with_begins)

    return let(pairs, by_chunks)


PIECE = 128


def pieces(text: Column) -> Column:
    """The text cut into pieces of PIECE characters; ``piece_at`` reads any stretch of it from these."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def piece_at(cut: Column, start: Column, length: Column) -> Column:
    """``length`` characters from the 0-based ``start`` on, from the pieces there alone.

    A substring of a long text counts its characters from the beginning; here
    the work does not depend on where the stretch lies.
    """
    inside = start % PIECE
    some = F.floor((inside + length + PIECE - 1) / PIECE).cast("int")
    near = F.slice(cut, F.floor(start / PIECE).cast("int") + 1, some)
    return F.array_join(near, "").substr(inside + 1, length)


def earlier_max(values: Column) -> Column:
    """The largest of the values (0 or more) before each one, -1 for the first.

    Worked out in chunks, so the work grows with the number of values.
    """
    numbers = "array<int>"

    def inside(begin, chunk):
        first = F.struct(begin.alias("at"), F.array().cast(numbers).alias("out"))
        return F.aggregate(chunk, first, lambda state, v: F.struct(
            F.greatest(state["at"], v).alias("at"),
            F.concat(state["out"], F.array(state["at"])).alias("out")), lambda state: state["out"])

    def by_chunks(all_values):
        chunks = F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(all_values) - 1, F.lit(0)), F.lit(CHUNK)),
            lambda at: F.slice(all_values, at + 1, CHUNK),
        )

        def with_begins(parts):
            first = F.struct(F.lit(-1).alias("at"), F.array().cast(numbers).alias("begins"))
            begins = F.aggregate(parts, first, lambda done, chunk: F.struct(
                F.greatest(done["at"], F.array_max(chunk)).alias("at"),
                F.concat(done["begins"], F.array(done["at"])).alias("begins")),
                lambda done: done["begins"])
            return F.flatten(F.zip_with(begins, parts, inside))

        return let(chunks, with_begins)

    return let(values.cast(numbers), by_chunks)


def occurrences(spaced: Column, needle: str) -> Column:
    """How often ``needle`` occurs in analysed text, without overlaps."""
    rest = F.replace(spaced, F.lit(needle), F.lit(""))
    gone = F.octet_length(spaced) - F.octet_length(rest)
    return (gone / F.lit(len(needle.encode()))).cast("long")


def token_count(spaced: Column) -> Column:
    blanks = F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(" "), F.lit("")))
    no_words = F.trim(spaced) == F.lit("")
    return F.when(no_words, F.lit(0)).otherwise(blanks / 2).cast("long")


def word_occurrences(spaced: Column, word: str) -> Column:
    return occurrences(spaced, f" {word} ")


def phrase_occurrences(spaced: Column, words: list[str]) -> Column:
    """Occurrences of consecutive words; each one may start inside the last."""
    needle = " " + "  ".join(words) + " "
    if any(words[:n] == words[-n:] for n in range(1, len(words))):
        # A phrase that ends as it begins can overlap itself.
        pieces = F.regexp_extract_all(spaced, F.lit(f"(?=({regex.escape(needle)}))"), F.lit(1))
        return F.size(pieces).cast("long")
    return occurrences(spaced, needle)


def swapped(word: Column) -> Column:
    """All words that a swap of two neighbouring letters makes of the word."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: F.concat(
        word.substr(F.lit(1), i - 1), word.substr(i + 1, F.lit(1)), word.substr(i, F.lit(1)), word.substr(i + 2, F.length(word))))


def within_edits(one: Column, other: Column, edits: int) -> Column:
    """Whether at most ``edits`` (0, 1 or 2) edits lie between two words.

    An edit inserts, deletes or replaces a letter or swaps two neighbours.  A
    swap and another edit come in either order.  The first test is cheap and
    drops nearly all words: an edit is at most two without swaps.
    """
    if not edits:
        return one == other

    def close(a, b, n):
        return F.levenshtein(a, b, n) >= 0

    if edits == 1:
        found = F.exists(swapped(one), lambda s: s == other)
    else:
        found = (F.exists(swapped(one), lambda s: close(s, other, 1)) | F.exists(swapped(other), lambda s: close(one, s, 1))
                 | F.arrays_overlap(swapped(one), swapped(other)))
    return F.length(one).between(F.length(other) - edits, F.length(other) + edits) & close(one, other, 2 * edits) & (
        close(one, other, edits) | found)


def fold_quotes(text: Column) -> Column:
    """Curly double and single quotes become straight ones."""
    return F.translate(text, "“”‘’", "\"\"''")


def text_or_null(value: Column) -> Column:
    """Empty text and the text "None" become null; other values become text."""
    return F.nullif(F.nullif(value.cast("string"), F.lit("")), F.lit("None"))


def keyword(text: Column, limit: int = 256) -> Column:
    """The value for exact use; nothing when it is longer than ``limit``."""
    return F.when(F.length(text) <= limit, text)


def split_list(text: Column) -> Column:
    """Comma list to array; blank text to null; items stay untrimmed."""
    body = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(body != "", F.split(body, ","))


def normalize_text_columns(df, blank_to_null=(), straight_quotes=(), upper=(), keywords=()):
    """Clean all the named columns in one projection."""
    new = {}
    for name in straight_quotes:
        new[name] = fold_quotes(new.get(name, F.col(name)))
    for name in upper:
        new[name] = F.upper(new.get(name, F.col(name)))
    for name in keywords:
        new[name] = keyword(new.get(name, F.col(name)))
    for name in blank_to_null:
        new[name] = text_or_null(new.get(name, F.col(name)))
    return df.withColumns(new) if new else df
