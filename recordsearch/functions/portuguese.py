"""Portuguese word stems by rule steps with regions.

The rules are written once, over a few operations, and run on Columns (a
vocabulary) and on plain text (the words of a query).  A region is the part of
a word behind a beginning of a given form, so "the ending lies in the region"
means that what is before the ending still has that beginning.
"""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

# The vowels and endings of the published Snowball rules for Portuguese (ã and õ are read as a~ and o~).
VOWELS = "aeiouáéíóúâêô"
NOUNS = """eza ezas ico ica icos icas ismo ismos ável ível ista istas oso osa osos osas amento amentos imento imentos
    adora ador aça~o adoras adores aço~es ante antes ância""".split()
VERBS = """ada ida ia aria eria iria ará ara erá era irá ava asse esse isse aste este iste ei arei erei irei am iam ariam
    eriam iriam aram eram iram avam em arem erem irem assem essem issem ado ido ando endo indo ara~o era~o ira~o ar er ir
    as adas idas ias arias erias irias arás aras erás eras irás avas es ardes erdes irdes ares eres ires asses esses isses
    astes estes istes is ais eis íeis aríeis eríeis iríeis áreis areis éreis ereis íreis ireis ásseis ésseis ísseis áveis
    ados idos ámos amos íamos aríamos eríamos iríamos áramos éramos íramos ávamos emos aremos eremos iremos ássemos êssemos
    íssemos imos armos ermos irmos eu iu ou ira iras""".split()

_V, _C = f"[{VOWELS}]", f"[^{VOWELS}]"
#: Beginnings before the regions.
R1 = f"{_C}*{_V}+{_C}"
R2 = R1 + R1
RV = f"(?:.{_C}{_C}*{_V}|{_V}{_V}{_V}*{_C}|{_C}{_V}.)"


class _OnText:
    """The operations on plain text."""

    @staticmethod
    def sub(word: str, pattern: str, new: str) -> str:
        return regex.sub(pattern, new.replace("$", "\\"), word)

    @staticmethod
    def same(one: str, other: str) -> bool:
        return one == other

    @staticmethod
    def pick(*cases):
        return next((value for holds, value in cases[:-1] if holds), cases[-1])

    @staticmethod
    def test(word: str, pattern: str) -> bool:
        return regex.search(pattern, word) is not None

    @staticmethod
    def bind(value, body):
        return body(value)


class _OnColumns:
    """The same operations on Columns."""

    @staticmethod
    def sub(word: Column, pattern: str, new: str) -> Column:
        return F.regexp_replace(word, pattern, new)

    @staticmethod
    def same(one: Column, other: Column) -> Column:
        return one == other

    @staticmethod
    def pick(*cases):
        out = F
        for holds, value in cases[:-1]:
            out = out.when(holds, value)
        return out.otherwise(cases[-1])

    @staticmethod
    def test(word: Column, pattern: str) -> Column:
        return word.rlike(pattern)

    @staticmethod
    def bind(value: Column, body) -> Column:
        """The value worked out once, however often ``body`` uses it."""
        return F.element_at(F.transform(F.array(value), body), 1)


def _any(endings) -> str:
    return "(?:" + "|".join(sorted(endings, key=lambda e: (-len(e), e))) + ")"


#: Endings of the first step with their region and what takes their place.
_FIRST = (
    (NOUNS, R2, ""), (("logia", "logias"), R2, "log"), (("uça~o", "uço~es"), R2, "u"), (("ência", "ências"), R2, "ente"),
    (("amente",), R1, ""), (("mente",), R2, ""), (("idade", "idades"), R2, ""), (("iva", "ivo", "ivas", "ivos"), R2, ""),
    (("ira", "iras"), RV, "ir"),
)
_ALL_FIRST = [e for endings, _, _ in _FIRST for e in endings]


def _standard(ops, word):
    """(changed, word) of the first step: the longest ending of its lists, if it lies in its region."""
    cases = []
    for endings, region, new in _FIRST:
        # no longer ending of any list may end the word
        longer = {e for e in _ALL_FIRST for own in endings if e != own and e.endswith(own) and e not in endings}
        behind = f"(?<!{_any({e[:-len(own)] for e in longer for own in endings if e.endswith(own)})})" if longer else ""
        before = "(?<=e)" if endings[0] == "ira" else ""
        pattern = f"^({region}.*?){behind}{before}{_any(endings)}$"
        out = ops.sub(word, pattern, "$1" + new)
        if endings == ("amente",):
            out = ops.bind(out, lambda o: ops.bind(ops.sub(o, f"^({R2}.*)iv$", "$1"), lambda less: ops.pick(
                (ops.same(less, o), ops.sub(o, f"^({R2}.*)(?:os|ic|ad)$", "$1")), ops.sub(less, f"^({R2}.*)at$", "$1"))))
        elif endings == ("mente",):
            out = ops.sub(out, f"^({R2}.*)(?:ante|avel|ível)$", "$1")
        elif endings[0] == "idade":
            out = ops.sub(out, f"^({R2}.*)(?:abil|ic|iv)$", "$1")
        elif endings[0] == "iva":
            out = ops.sub(out, f"^({R2}.*)at$", "$1")
        cases.append((ops.test(word, pattern), out))
    return ops.pick(*cases, word)


def _endings(ops, word):
    """The word without the ending of a noun, else of a verb, else without a last vowel; an i behind c goes where an ending went."""
    def behind(first):
        verb = ops.sub(word, f"^({RV}.*?){_any(VERBS)}$", "$1")
        return ops.bind(ops.pick((ops.same(first, word), verb), first), lambda changed: ops.pick(
            (ops.same(changed, word), ops.sub(word, f"^({RV}.*?)(?:os|[aioáíó])$", "$1")),
            ops.sub(changed, f"^({RV}.*)(?<=c)i$", "$1")))

    return ops.bind(_standard(ops, word), behind)


def _last_letters(ops, word):
    """Without a last e, and without the u or i that is left behind g or c."""
    def behind(less):
        tail = ops.sub(ops.sub(less, f"^({RV}.*)(?<=g)u$", "$1"), f"^({RV}.*)(?<=c)i$", "$1")
        return ops.pick((ops.same(less, word), ops.sub(word, "ç$", "c")), tail)

    return ops.bind(ops.sub(word, f"^({RV}.*)[eéê]$", "$1"), behind)


def _stem(ops, word):
    word = ops.sub(ops.sub(word, "ã", "a~"), "õ", "o~")
    found = ops.bind(ops.bind(word, lambda w: _endings(ops, w)), lambda w: _last_letters(ops, w))
    return ops.sub(ops.sub(found, "a~", "ã"), "o~", "õ")


def stem_text(word: str) -> str:
    """The stem of one lower-case word."""
    return _stem(_OnText, word)


def stem(word: Column) -> Column:
    """The stem of lower-case words; meant for a vocabulary, where each word is worked out once."""
    return _stem(_OnColumns, word)
