"""Excerpts around matches, with tags.  Meant for the rows of a page.

Rule: fragments come in text order.  A fragment opens at the first match not
yet covered, with that match in its middle, has at most ``size`` characters
(a longer match is kept whole) and takes in every later match that fits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordsearch.functions.text import EXACT, Analysis, earlier_max, let, located_tokens
from recordsearch.operators.match import Fuzzy, Not, Phrase, Prefix, Word, near, AllOf, AnyOf

SPAN = "array<struct<start:int,stop:int,clause:int>>"


def positive_leaves(clause) -> list:
    """Leaves that can mark text: those not under a negation."""
    if isinstance(clause, Not):
        return []
    if isinstance(clause, (AllOf, AnyOf)):
        return list(dict.fromkeys(leaf for c in clause.clauses for leaf in positive_leaves(c)))
    return [clause] if isinstance(clause, (Word, Prefix, Fuzzy, Phrase)) else []


def _leaf_spans(leaf, number: int, tokens: Column, analysis: Analysis) -> Column:
    def form(token):
        return analysis.stem(F.lower(token))

    if isinstance(leaf, Phrase) and " " in leaf.text:
        words = leaf.text.split(" ")
        if leaf.slop:
            inner = [_leaf_spans(Word(w), number, tokens, analysis) for w in dict.fromkeys(words)]
            return F.concat(*inner)
        last = F.size(tokens) - len(words) + 1
        starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(
            F.array().cast("array<int>")
        )
        wanted = F.array(*[F.lit(w) for w in words])
        hits = F.filter(
            starts,
            lambda i: F.transform(F.slice(tokens, i, len(words)), lambda t: form(t["token"]))
            == wanted,
        )
        return F.transform(
            hits,
            lambda i: F.struct(
                F.element_at(tokens, i)["start"].alias("start"),
                F.element_at(tokens, i + (len(words) - 1))["stop"].alias("stop"),
                F.lit(number).alias("clause"),
            ),
        )

    def hit(token):
        if isinstance(leaf, Prefix):
            return F.startswith(form(token), F.lit(leaf.text))
        if isinstance(leaf, Fuzzy):
            return near(form(token), leaf.text, leaf.edits)
        return form(token) == leaf.text

    return F.transform(
        F.filter(tokens, lambda t: hit(t["token"])),
        lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("stop"),
                           F.lit(number).alias("clause")),
    )


def match_spans(text: Column, clause, plain: Analysis = EXACT, exact: Analysis = EXACT) -> Column:
    """Marked stretches of both analyses together, overlaps merged, in order."""
    def spans_of(numbered, analysis):
        return lambda tokens: F.concat(*[_leaf_spans(x, n, tokens, analysis) for n, x in numbered])

    marked = list(enumerate(positive_leaves(clause)))
    groups = []
    for analysis, phrases in ((plain, False), (exact, True)):
        mine = [(n, x) for n, x in marked if isinstance(x, Phrase) == phrases]
        if mine:
            tokens = located_tokens(text, analysis.token_pattern)
            groups.append(let(tokens, spans_of(mine, analysis)))
    if not groups:
        return F.array().cast(SPAN)
    ordered = F.array_sort(reduce(lambda a, b: F.concat(a, b), groups))

    # A span opens a stretch when it starts behind all spans before it; the
    # stretch ends where those before the next opening end at most.
    def with_max(spans):
        before = earlier_max(F.transform(spans, lambda s: s["stop"]))
        placed = F.zip_with(spans, before, lambda s, m: F.struct(s.alias("s"), m.alias("before")))
        opening = F.filter(placed, lambda p: p["s"]["start"] >= p["before"])
        end = F.array_max(F.transform(spans, lambda s: s["stop"]))

        def closed(found):
            following = F.concat(F.transform(F.slice(found, F.lit(2), F.size(found)), lambda p: p["before"]), F.array(end))
            return F.zip_with(found, following, lambda p, stop: F.struct(
                p["s"]["start"].alias("start"), stop.alias("stop"), p["s"]["clause"].alias("clause")))

        return let(opening, closed)

    return F.when(F.size(ordered) > 0, let(ordered.cast(SPAN), with_max)).otherwise(F.array().cast(SPAN)).cast(SPAN)


def _fragments(text: Column, spans: Column, size: int, count: int) -> Column:
    """Windows of the text: array of (start, stop)."""
    window = "array<struct<start:int,stop:int>>"

    def step(done, span):
        wide = span["stop"] - span["start"]
        room = F.greatest(F.lit(size) - wide, F.lit(0))
        before = F.floor(room / 2).cast("int")
        free_from = F.coalesce(F.try_element_at(done, F.lit(-1))["stop"], F.lit(0))
        begin = F.greatest(span["start"] - before, F.lit(0), free_from)
        end = F.greatest(F.least(begin + F.lit(size), F.length(text)), span["stop"])
        # At the end of the text the unused room goes to the left.
        begin = F.least(begin, F.greatest(end - F.lit(size), F.lit(0), free_from))
        opened = F.struct(begin.alias("start"), end.alias("stop"))
        covered = (F.size(done) > 0) & (span["start"] < free_from)
        return F.when(covered | (F.size(done) >= count), done).otherwise(
            F.concat(done, F.array(opened))
        )

    return F.aggregate(spans, F.array().cast(window), step)


def highlight(
    text: Column, clause, plain: Analysis = EXACT, exact: Analysis = EXACT,
    size: int = 500, count: int = 1, pre_tags=("",), post_tags=("",),
) -> Column:
    """Up to ``count`` excerpts of at most ``size`` characters; none without a match.

    Several tag pairs are used in turn, by the number of the clause.
    """
    if clause is None or not positive_leaves(clause):
        return F.array().cast("array<string>")
    pre = F.array(*[F.lit(t) for t in (list(pre_tags) or [""])])
    post = F.array(*[F.lit(t) for t in (list(post_tags) or [""])])

    def tag(tags, number):
        return F.element_at(tags, (F.pmod(number, F.size(tags)) + 1).cast("int"))

    def render(spans, frag):
        def step(state, span):
            piece = F.concat(
                F.substring(text, state["at"] + 1, span["start"] - state["at"]),
                tag(pre, span["clause"]),
                F.substring(text, span["start"] + 1, span["stop"] - span["start"]),
                tag(post, span["clause"]),
            )
            return F.struct(
                span["stop"].alias("at"), F.concat(state["out"], piece).alias("out")
            )

        inside = F.filter(
            spans, lambda s: (s["start"] >= frag["start"]) & (s["stop"] <= frag["stop"])
        )
        return F.aggregate(
            inside,
            F.struct(frag["start"].alias("at"), F.lit("").alias("out")),
            step,
            lambda state: F.concat(
                state["out"], F.substring(text, state["at"] + 1, frag["stop"] - state["at"])
            ),
        )

    # The spans are bound once; every fragment is cut from them.
    bound = F.transform(
        F.array(match_spans(text, clause, plain, exact)),
        lambda spans: F.transform(
            _fragments(text, spans, size, count), lambda frag: render(spans, frag)
        ),
    )
    return F.coalesce(F.element_at(bound, 1), F.array().cast("array<string>"))
