"""Text clauses and what they mean on analysed text.

Unquoted words, prefixes and fuzzy words are looked up in the plain analysis,
phrases in the exact one.  A clause tree becomes one Boolean Column and one
score Column over the analysed text, so a search is a single pass without a
shuffle; only phrases with slop need word positions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordsearch.functions.text import (
    EXACT, Analysis, occurrences, phrase_occurrences, within_edits, word_occurrences,
)


@dataclass(frozen=True)
class Word:
    text: str


@dataclass(frozen=True)
class Prefix:
    text: str


@dataclass(frozen=True)
class Fuzzy:
    """A word within some edits; more than two count as two, in text and here."""

    text: str
    edits: int = 2

    def __post_init__(self):
        object.__setattr__(self, "edits", min(self.edits, 2))


@dataclass(frozen=True)
class Phrase:
    text: str
    slop: int = 0


@dataclass(frozen=True)
class AllOf:
    clauses: tuple


@dataclass(frozen=True)
class AnyOf:
    clauses: tuple


@dataclass(frozen=True)
class Not:
    clause: object


@dataclass(frozen=True)
class Nothing:
    """A text that leaves no words matches no document."""


def read_clauses(text: str):
    """Turn search text into a clause tree.

    Blank means or; ``+`` and; ``|`` or; ``-`` not; ``"…"`` phrase; ``*`` at a
    word's end prefix; ``~N`` after a word or phrase edits or slop (``~`` alone
    after a word: two edits); ``( )`` groups; a backslash makes the next
    character an ordinary one.  Operators apply from left to right.
    """
    pieces = regex.findall(
        r'"(?:\\.|[^"\\])*"(?:~\d+)?|[()+|]|-(?=\S)|(?:\\.|[^\s()+|"\\])+|\\', text, regex.DOTALL)

    def group(at: int):
        tree, joiner, negate = None, None, False
        while at < len(pieces):
            piece, at = pieces[at], at + 1
            if piece == ")":
                break
            if piece in "+|":
                joiner = AllOf if piece == "+" else AnyOf
                continue
            if piece == "-":
                negate = not negate
                continue
            clause, at = group(at) if piece == "(" else (_leaf(piece), at)
            if clause is not None:
                clause = Not(clause) if negate else clause
                kind = joiner or AnyOf
                if tree is None:
                    tree = clause
                elif isinstance(tree, kind):
                    tree = kind((*tree.clauses, clause))
                else:
                    tree = kind((tree, clause))
            joiner, negate = None, False
        return tree, at

    at, tree = 0, None
    while at < len(pieces):
        part, at = group(at)
        tree = part if tree is None else tree if part is None else AnyOf((tree, part))
    return tree if tree is not None else Nothing()


def _leaf(piece: str):
    body, mark, number = piece, "", ""
    tail = regex.fullmatch(r"(.*[^\\](?:\\\\)*)~(\d*)", piece, regex.DOTALL)
    if tail:
        body, mark, number = tail[1], "~", tail[2]
    if body.startswith('"'):
        body = _unescaped(body[1:-1] if body.endswith('"') else body[1:])
        return Phrase(body, int(number or 0)) if body.strip() else None
    if mark:
        return Fuzzy(_unescaped(body), int(number or 2))
    stem = body.rstrip("*")
    if stem and stem != body and not regex.search(r"(?<!\\)(?:\\\\)*\\$", stem):
        return Prefix(_unescaped(stem))
    return Word(_unescaped(body))


def _unescaped(text: str) -> str:
    return regex.sub(r"\\(.)", r"\1", text, flags=regex.DOTALL)


def resolve(clause, plain: Analysis, exact: Analysis = EXACT):
    """Analyse the clause words: every leaf ends up with analysed words.

    A leaf that the analysis leaves without words says nothing: it is left out
    of the clauses around it, also where it is negated.  Only a tree without
    any word is ``Nothing``.
    """
    found = _resolved(clause, plain, exact)
    return Nothing() if found is None else found


def _resolved(clause, plain: Analysis, exact: Analysis):
    if isinstance(clause, Word):
        words = plain.words(clause.text)
        if not words:
            return None
        return Word(words[0]) if len(words) == 1 else AnyOf(tuple(Word(w) for w in words))
    if isinstance(clause, Phrase):
        words = exact.words(clause.text)
        return Phrase(" ".join(words), clause.slop) if words else None
    if isinstance(clause, Prefix):
        return Prefix(clause.text.lower())
    if isinstance(clause, Fuzzy):
        return Fuzzy(clause.text.lower(), clause.edits)
    if isinstance(clause, Not):
        inner = _resolved(clause.clause, plain, exact)
        return None if inner is None else Not(inner)
    if isinstance(clause, (AllOf, AnyOf)):
        parts = tuple(c for c in (_resolved(c, plain, exact) for c in clause.clauses) if c is not None)
        return type(clause)(parts) if len(parts) > 1 else parts[0] if parts else None
    return clause


def leaves(clause) -> list:
    if isinstance(clause, (AllOf, AnyOf)):
        found = [leaf for c in clause.clauses for leaf in leaves(c)]
    elif isinstance(clause, Not):
        found = leaves(clause.clause)
    else:
        found = [] if isinstance(clause, Nothing) else [clause]
    return list(dict.fromkeys(found))


def near(token: Column, word: str, edits: int) -> Column:
    """Within the edit distance; the length test spares most of the work."""
    size = F.length(token)
    return size.between(len(word) - edits, len(word) + edits) & within_edits(token, F.lit(word), edits)


def frequency(leaf, plain: Column, exact: Column) -> Column:
    """Occurrences of a leaf clause in the analysed text."""
    if isinstance(leaf, Word):
        return word_occurrences(plain, leaf.text)
    if isinstance(leaf, Prefix):
        return occurrences(plain, f" {leaf.text}")
    if isinstance(leaf, Phrase):
        return phrase_occurrences(exact, leaf.text.split(" "))
    tokens = F.split(F.trim(plain), "  ")
    return F.size(F.filter(tokens, lambda t: near(t, leaf.text, leaf.edits))).cast("long")


def present(leaf, plain: Column, exact: Column) -> Column:
    """Whether a leaf clause occurs; a substring test wherever possible."""
    if isinstance(leaf, Word):
        return F.contains(plain, F.lit(f" {leaf.text} "))
    if isinstance(leaf, Prefix):
        return F.contains(plain, F.lit(f" {leaf.text}"))
    if isinstance(leaf, Phrase):
        return F.contains(exact, F.lit(" " + leaf.text.replace(" ", "  ") + " "))
    tokens = F.split(F.trim(plain), "  ")
    return F.exists(tokens, lambda t: near(t, leaf.text, leaf.edits))


def condition(clause, of_leaf) -> Column:
    """The tree as one Boolean Column; ``of_leaf`` gives the Column of a leaf."""
    if isinstance(clause, AllOf):
        return reduce(lambda a, b: a & b, [condition(c, of_leaf) for c in clause.clauses])
    if isinstance(clause, AnyOf):
        return reduce(lambda a, b: a | b, [condition(c, of_leaf) for c in clause.clauses])
    if isinstance(clause, Not):
        return ~condition(clause.clause, of_leaf)
    if isinstance(clause, Nothing):
        return F.lit(False)
    return of_leaf(clause)


def raw_hint(clause, low_text: Column) -> Column | None:
    """A cheap test on lower-cased raw text that no matching row can fail.

    It runs before any analysis and leaves most rows out of it.  Clauses that
    say nothing about the raw text (negation, fuzzy words) give None.
    """
    if isinstance(clause, AllOf):
        parts = [h for h in (raw_hint(c, low_text) for c in clause.clauses) if h is not None]
        return reduce(lambda a, b: a & b, parts) if parts else None
    if isinstance(clause, AnyOf):
        parts = [raw_hint(c, low_text) for c in clause.clauses]
        return None if any(p is None for p in parts) else reduce(lambda a, b: a | b, parts)
    if isinstance(clause, (Word, Prefix)):
        return F.contains(low_text, F.lit(clause.text))
    if isinstance(clause, Phrase):
        words = dict.fromkeys(clause.text.split(" "))
        return reduce(lambda a, b: a & b, [F.contains(low_text, F.lit(w)) for w in words])
    return None


def phrase_slop(
    df: DataFrame, key: str, exact: str, phrase: Phrase
) -> DataFrame:
    """Documents whose words lie within ``slop`` moves of the phrase.

    Each word's position is moved back by its place in the phrase; a match is
    a stretch of at most ``slop`` moved positions that holds every place.  A
    stretch is found with one range frame per document, not with word pairs,
    and only words of the phrase in documents that hold all of them are read.
    """
    words = phrase.text.split(" ")
    repeated = {w for w in words if words.count(w) > 1}
    has_all = reduce(
        lambda a, b: a & b, [F.contains(F.col(exact), F.lit(f" {w} ")) for w in dict.fromkeys(words)]
    )
    spots = (
        df.where(has_all)
        .select(key, F.posexplode(F.split(F.trim(F.col(exact)), "  ")).alias("pos", "token"))
        .where(F.col("token").isin(*words))
    )
    places = F.explode(
        F.array_compact(F.array(*[
            F.when(F.col("token") == w, F.struct(F.lit(i).alias("place"),
                                                 (F.col("pos") - i).alias("moved")))
            for i, w in enumerate(words)
        ]))
    )
    frame = Window.partitionBy(key).orderBy("moved").rangeBetween(0, phrase.slop)
    seen = F.size(F.collect_set("place").over(frame))
    ok = F.lit(True)
    flagged = spots.select(key, "pos", "token", places.alias("p")).select(
        key, "pos", "token", "p.place", "p.moved"
    )
    flagged = flagged.withColumn("seen", seen)
    for n, word in enumerate(sorted(repeated)):
        spots_of = F.size(F.collect_set(F.when(F.col("token") == word, F.col("pos"))).over(frame))
        flagged = flagged.withColumn(f"n{n}", spots_of)
        ok = ok & (F.col(f"n{n}") >= words.count(word))
    return flagged.where((F.col("seen") == len(words)) & ok).select(key).distinct()
