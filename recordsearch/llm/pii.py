"""Personal data in texts (native: built-in expressions only).

Regular expressions propose spans, checksums confirm them, and words before a
span move its score.  Positions are code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in order.  The first four have a base rule each, whose spans always stay.
KINDS = ("email", "ip", "card", "phone", "iban")

# The base rules, written so that every character is looked at a few times at
# most: possessive where giving back cannot help, and an email only where its
# leftmost match can begin, at the first character of a run or where the last
# match ended.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: More spans of the method: cards inside longer runs of digits, account
#: numbers, and numbers without a country code.
MORE = {
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{1,7}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![0-9+)\x20(-])\x20?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: A text without this part has no match of the kind.
GUARD = {"email": "[@]", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){11}[0-9]", "phone": r"\+[0-9]",
         "iban": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", "local": r"[0-9]{3}[\x20.-][0-9]{4}"}
#: Words near a span that speak for its kind.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\b", "ip": r"(?i)\b(?:ip|host|server|address|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|pay)", "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|cell)",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)",
}
AGAINST = r"(?i)\b(?:version|order|isbn|invoice|page|build|item)\b"
#: Score before context, gain and loss by context, and what an added span needs.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}
GAIN, LOSS, LEAST, NEAR = 0.1, 0.3, 0.7, 40
_BLOCK = 256


def running_sums(numbers: Column) -> Column:
    """Sums of the array before each element.

    Works in blocks: per block first, then inside each, so that long arrays
    take time in proportion to their length.
    """
    n = F.size(numbers)
    def sums(part, start):
        return F.slice(F.aggregate(
            part, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))),
            1, F.size(part))
    def block(b):
        return F.slice(numbers, b * _BLOCK + 1, _BLOCK)
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int"))
    totals = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda a, x: a + x))
    starts = F.zip_with(blocks, sums(totals, F.lit(0)), lambda b, s: F.struct(b.alias("b"), s.alias("s")))
    return F.when(n > 0, F.flatten(F.transform(starts, lambda x: sums(block(x["b"]), x["s"])))) \
        .otherwise(F.array().cast("array<int>"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check of card numbers: from the right every second digit doubled, digits summed, by ten."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise(F.floor(d.cast("int") / 5) + d.cast("int") * 2 % 10))
    return F.aggregate(values, F.lit(0), lambda a, x: (a + F.coalesce(x, F.lit(0))).cast("int")) % 10 == 0


def mod97(account: Column) -> Column:
    """The check of account numbers: the first four behind, letters as 10 to 35, rest 1 by 97."""
    moved = F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4))
    digits = F.transform(F.filter(F.split(moved, ""), lambda c: c != ""), lambda c: F.when(
        c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(digits, F.lit(0), lambda a, x: F.when(
        x > 9, a * 100 + x).otherwise(a * 10 + x) % 97) == 1


def _card(text: Column) -> Column:
    n = F.length(_digits(text))
    return F.when(n.between(12, 19), luhn(_digits(text))).otherwise(False)


def _small_parts(text: Column) -> Column:
    """All four parts are 255 at most, leading zeros left out."""
    return text.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")


VALID = {
    "email": lambda t: F.lit(True), "ip": _small_parts, "card": _card,
    "phone": lambda t: F.length(_digits(t)).between(9, 15),
    "iban": lambda t: mod97(F.replace(t, F.lit(" "), F.lit(""))),
}


def _places(pattern: str, guard: str, kind: str, base: bool, have: str, text: str) -> Column:
    """Valid matches as (start, kind, end, base), in text order; ``have`` is the array of matches."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean>>")
    pieces = F.split(F.col(text), pattern, -1)
    lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(have)), F.col(have),
                         lambda p, m: F.length(p) + F.length(m))
    ends = F.zip_with(F.col(have), running_sums(lengths), lambda m, s: F.struct(m.alias("m"), s.alias("s")))
    at = F.zip_with(F.slice(pieces, F.lit(1), F.size(have)), ends, lambda p, e: F.struct(
        (e["s"] + F.length(p)).alias("start"), e["m"].alias("m")))
    kept = F.filter(at, lambda x: VALID[kind](x["m"]))
    return F.when(F.size(have) > 0, F.transform(kept, lambda x: F.struct(
        x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
        (x["start"] + F.length(x["m"])).alias("end"), F.lit(base).alias("base")))).otherwise(none)


def _score(span: Column, text: Column) -> Column:
    """Prior of the kind, moved by the words before the span."""
    first = F.greatest(span["start"] - NEAR, F.lit(0))
    near = F.substring(text, first + 1, span["start"] - first)
    prior = F.element_at(F.array(*[F.lit(PRIOR[k]) for k in KINDS]), span["kind"] + 1)
    speaks = F.lit(False)
    for i, k in enumerate(KINDS):
        speaks = speaks | ((span["kind"] == i) & near.rlike(CONTEXT[k]))
    return F.round(prior + F.when(speaks, GAIN).otherwise(0) - F.when(near.rlike(AGAINST), LOSS).otherwise(0), 2)


def find_pii(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """Every row with an array of its spans: start, kind, end, base, score.

    Base spans are those of the base rules; the method adds cards inside
    longer runs of digits, accounts that pass mod-97 and phone numbers without
    country code, each only with a score of 0.7 or more and where no base span
    overlaps.  Spans are in order of start, then kind as in KINDS.

    Null and empty texts have no spans.  Texts are read whole, however long.
    Repeated rows stay repeated, other columns stay as they are, a column
    named ``into`` is replaced; an empty table stays empty.
    """
    own = "__pii_text"
    found = docs.withColumn(own, F.coalesce(F.col(text), F.lit("")))
    none = F.array().cast("array<string>")
    rules = [(f"__b{k}", BASE[k], GUARD[k], k, True) for k in BASE]
    rules += [(f"__m{k}", MORE[k], GUARD["local" if k == "phone" else k], k, False) for k in MORE]
    digit = F.col(own).rlike("[0-9]")
    for name, pattern, guard, kind, _ in rules:
        test = F.contains(F.col(own), F.lit("@")) if kind == "email" else digit & F.col(own).rlike(guard)
        found = found.withColumn(name, F.when(test, F.regexp_extract_all(own, F.lit(pattern), 0)).otherwise(none))
    spans = [(_places(p, g, k, b, n, own), b) for n, p, g, k, b in rules]
    found = found.withColumn("__base", F.concat(*[s for s, b in spans if b]))
    found = found.withColumn("__more", F.concat(*[s for s, b in spans if not b]))
    def scored(name):
        return F.transform(name, lambda s: s.withField("score", _score(s, F.col(own))))
    found = found.withColumn("__base", scored("__base")).withColumn("__more", F.filter(
        scored("__more"), lambda s: (s["score"] >= LEAST) & ~F.exists("__base", lambda b: (
            b["start"] < s["end"]) & (s["start"] < b["end"]))))
    result = F.array_sort(F.concat("__base", "__more"))
    keep = [c for c in docs.columns if c != into]
    return found.select(*keep, result.alias(into))


def mask_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with each span of ``text`` replaced by its kind in brackets.

    Of overlapping spans the first in order is replaced; null texts stay null.
    """
    found = find_pii(docs, text, "__pii")
    spans = F.aggregate("__pii", F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean,score:double>>"),
                        lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > s["start"]), acc)
                        .otherwise(F.concat(acc, F.array(s))))
    found = found.withColumn("__pii", F.when(F.size("__pii") > 0, spans).otherwise(F.col("__pii")))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    parts = F.transform("__pii", lambda s, i: F.concat(
        F.substr(F.col(text), F.when(i == 0, 1).otherwise(F.try_element_at("__pii", i)["end"] + 1),
                 s["start"] - F.when(i == 0, 0).otherwise(F.try_element_at("__pii", i)["end"])),
        F.element_at(names, s["kind"] + 1)))
    masked = F.concat(F.array_join(parts, ""), F.substr(F.col(text), F.element_at("__pii", -1)["end"] + 1))
    return found.withColumn(text, F.when(F.size("__pii") > 0, masked).otherwise(F.col(text))).select(*docs.columns)


def _listed(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kind, s["kind"] + 1), s["start"], s["end"])), ",")


def op7_pii(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = F.filter("pii", lambda s: s["base"])
    def of_kind(k):
        return F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    counts = [of_kind(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return find_pii(docs).select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"),
                                 _listed(F.col("pii")).alias("spans"))
