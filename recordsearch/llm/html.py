"""Main text of web pages by differencing with the page of the nearest address.

Pages are cut into blocks of text.  Each page is paired, within its host, with
its neighbour in path order; blocks that both have in the same order (longest
common subsequence) are template text and go.  Where the markup itself says
what a block is, that is used as well: blocks of menus, adverts, comments and
the like go even if no neighbour shares them, and blocks inside an article
element stay even if a copy of the article is the neighbour.
"""

from __future__ import annotations

import bisect
import hashlib
import html as entities
import re
from collections import Counter
from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordsearch.llm.common import attach, checkpointed, parts as tasks

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small "
                   "span strike strong sub sup time tt u var wbr td th input label".split())
#: Elements whose text is never the article's.
AROUND = frozenset("nav footer aside button select option dialog menu svg canvas object audio video head "
                   "header script style noscript template iframe".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar".split())
#: Words in class or id that say the same; those of the second list only outside an article.
WORDS = frozenset("ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion nav navbar "
                  "navigation menu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices popup "
                  "modal overlay newsletter subscribe subscription share sharing social related recommended "
                  "recommendations comment comments disqus respond replies login signin signup search pagination pager "
                  "toolbar copyright skip hidden banner widget".split())
OUTSIDE = frozenset("header masthead topbar top bottom meta tags author".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
#: An element with more of the page's text than this is the page, whatever its class or id says.
MOST_TEXT = 0.5
#: A block mostly made of links is a menu.
MOST_LINKED = 0.5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:\"[^\"]*\"|'[^']*'|[^<>\"']++)*+)>"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|<[!?][^<>]*+>", re.S)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"']+))?", re.I)


@lru_cache(maxsize=4096)
def _around(attributes: str, inside: bool) -> int:
    """Do the attributes name something other than article text?  2: by role or as hidden; 1: by a word of class or id."""
    named = 0
    for name, value in _NAMED.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            words = set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()))
            if words & WORDS or not inside and words & OUTSIDE:
                named = 1
        elif name == "role" and value.lower() in ROLES or name == "hidden" or \
                name == "aria-hidden" and value.lower() == "true" or \
                name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return 2
    return named


def blocks(page: str) -> list[tuple[str, int]]:
    """Blocks in page order with a role: 2 inside an article, 1 undecided; all others are left out.

    In a page with an article, undecided blocks are those of its main element;
    in a page without, all that no markup speaks against.  A form, or a word in
    class or id, speaks against an element's text unless the element holds the
    longest of the article and main elements or, in a page with neither, most
    of the text.
    """
    found: list[list] = []  # text, in article, in main, share of linked characters, named elements around it, holder
    stack: list[tuple] = []  # tag; depth of: around, article, main, links; named elements; holder
    named: tuple[int, ...] = ()  # numbers of the open elements that a class, an id or a form speaks against
    count = holder = 0
    holders: dict[int, tuple[int, ...]] = {}  # article and main elements with the named elements around each
    parts: list[str] = []
    linked = total = 0
    around = article = main = links = 0
    has_main = False

    def close():
        nonlocal linked, total
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append([text, article > 0, main > 0, linked / max(total, 1), named, holder])
            parts.clear()
        linked = total = 0

    def pop(to: int):
        nonlocal around, article, main, links, named, holder
        _, around, article, main, links, named, holder = stack[to]
        del stack[to:]

    def say(text: str):
        nonlocal linked, total
        if text and not around:
            if "&" in text:
                text = entities.unescape(text)
            parts.append(text)
            total += len(text)
            linked += len(text) if links else 0

    at, size = 0, len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        if token is None:
            say(page[at:])
            break
        say(page[at:token.start()])
        at = token.end()
        end, tag, attributes = token[1], token[2], token[3]
        if tag is None:
            end, tag, attributes = token[4], token[5], token[6]
            if tag is None:
                continue
        tag = tag.lower()
        if tag not in INLINE:
            close()
        elif tag in ("br", "td", "th", "img"):
            say(" ")
        if end:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                if stack[i][0] in ("article", "main", "body") and tag not in ("article", "main", "body", "html"):
                    break  # a stray end tag does not close the article
            continue
        if tag in RAW and not attributes.endswith("/"):
            finish = re.compile(rf"</{tag}(?=[\s/>])[^<>]*+>?", re.I).search(page, at)
            at = finish.end() if finish else size
            continue
        if tag in VOID or attributes.endswith("/") and tag not in ("p", "div"):
            continue
        closes = CLOSES.get(tag) or ({"p"} if tag not in INLINE else None)
        if closes:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    pop(i)
                    break
                if stack[i][0] not in INLINE and stack[i][0] != "p":
                    break
        stack.append((tag, around, article, main, links, named, holder))
        against = _around(attributes, bool(article)) if attributes and tag not in ("html", "body") else 0
        opens = tag == "article" or "articlebody" in attributes.lower()
        if tag == "header":
            around += not article
        elif tag in AROUND:
            around += 1
        elif against == 2:
            around += 1
        elif tag == "form" or against:
            count += 1
            named += (count,)
        elif opens:
            article += 1
            holder = len(holders) + 1
            holders[holder] = named
        elif tag == "main" or re.search(r"role\s*=\s*[\"']?main\b", attributes):
            main += 1
            holder = len(holders) + 1
            holders[holder] = named
            has_main = True
        links += tag == "a"
    close()
    sizes: Counter = Counter()
    if holders:
        for text, *_, names, within in found:
            if within and names == holders[within]:
                sizes[within] += len(text)
        wrappers = set(holders[max(sizes, key=sizes.get)]) if sizes else set()
    else:
        for text, *_, names, _ in found:
            sizes.update(dict.fromkeys(names, len(text)))
        wrappers = {x for x, n in sizes.items() if n > MOST_TEXT * sum(len(b[0]) for b in found)}
    found = [x for x in found if wrappers.issuperset(x[4])]
    has_article = any(x[1] for x in found)
    return [(text, 2 if inside else 1) for text, inside, in_main, share, *_ in found
            if inside or share <= MOST_LINKED and (in_main if has_main else not has_article)]


def address(url: str | None) -> tuple[str, str]:
    """Host and path with query; empty without an address."""
    if not url:
        return "", ""
    try:
        parts = urlsplit(url)
        return (parts.hostname or "").removeprefix("www."), f"{parts.path.rstrip('/') or '/'}?{parts.query}"
    except ValueError:
        return "", url


def line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def shared_lines(own: list[int], other: list[int]) -> list[bool]:
    """Which lines of ``own`` are in a longest common subsequence with ``other``.

    Repeated lines are matched by their number of occurrence, so every line is
    unique and the subsequence is a longest increasing one.
    """
    def numbered(lines):
        seen: dict[int, int] = {}
        for x in lines:
            seen[x] = seen.get(x, -1) + 1
            yield x, seen[x]

    place = {x: i for i, x in enumerate(numbered(other))}
    pairs = [(i, place[x]) for i, x in enumerate(numbered(own)) if x in place]
    tails, links, last = [], [-1] * len(pairs), []
    for n, (_, j) in enumerate(pairs):
        k = bisect.bisect_left(tails, j)
        tails[k:k + 1] = [j]
        last[k:k + 1] = [n]
        links[n] = last[k - 1] if k else -1
    shared = [False] * len(own)
    n = last[-1] if last else -1
    while n >= 0:
        shared[pairs[n][0]] = True
        n = links[n]
    return shared


_PARSED = "page_id long, url string, host string, path string, digest string, lines array<long>, texts array<string>, roles array<int>"


def parsed_pages(pages: DataFrame, page_id: str, url: str, html: str, texts: bool) -> DataFrame:
    """One row per page; ``digest`` names the host and the lines, so copies in a host share it."""
    source = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                          F.col(html).cast("string").alias("html"))

    def parse(batches):
        for batch in batches:
            out = []
            for number, link, page in batch[["page_id", "url", "html"]].itertuples(index=False, name=None):
                link = link if isinstance(link, str) else None
                found = blocks(page) if isinstance(page, str) else []
                host, path = address(link)
                lines = [line_hash(t) for t, _ in found]
                digest = hashlib.blake2b(np.array(lines, dtype=np.int64).tobytes() + host.encode("utf-8", "surrogatepass"),
                                         digest_size=16).hexdigest()
                out.append((number, link, host, path, digest, lines, [t for t, _ in found] if texts else [], [r for _, r in found]))
            yield pd.DataFrame(out, columns=["page_id", "url", "host", "path", "digest", "lines", "texts", "roles"]).astype(
                {"page_id": "Int64"})

    return source.mapInPandas(parse, _PARSED)


def neighbour_lines(parsed: DataFrame) -> DataFrame:
    """(digest, shared, n): per distinct page of a host, which lines its nearest neighbour shares.

    Distinct pages are sorted by host and path over range partitions.  Each is
    compared with the one before or behind, whichever path has the longer
    common start (the one before if equal).  Neighbours across the edge of a
    partition come from a list of the first and last page of every partition,
    which has two rows per task.
    """
    distinct = parsed.groupBy("digest").agg(
        F.min(F.struct("host", "path")).alias("at"), F.any_value("lines").alias("lines"), F.count("*").alias("n"))
    order = ["host", "path", "digest"]
    sorted_ = checkpointed(
        distinct.select("at.host", "at.path", "digest", "lines", "n").repartitionByRange(tasks(parsed), *order)
        .sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    key = F.struct(*order)
    page = F.struct("host", "path", "lines")
    edges = {r.part: (r.first, r.last) for r in sorted_.groupBy("part").agg(
        F.min_by(page, key).alias("first"), F.max_by(page, key).alias("last")).collect()}
    parts = sorted(edges)
    before = {p: tuple(edges[q][1]) for q, p in zip(parts, parts[1:], strict=False)}
    behind = {p: tuple(edges[q][0]) for p, q in zip(parts, parts[1:], strict=False)}

    def common(a: str, b: str) -> int:
        return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))

    def decide(own, previous, following):
        sides = [x for x in (previous, following) if x is not None and x[0] == own[0]]
        if not sides:
            return [False] * len(own[2])
        other = max(sides, key=lambda x: common(own[1], x[1]))
        return shared_lines(list(own[2]), list(other[2]))

    def compare(batches):
        previous = current = None
        name = part = count = None
        for batch in batches:
            out = []
            for host, path, digest, lines, n, where in batch.itertuples(index=False, name=None):
                page = (host, path, lines)
                if current is None:
                    part, previous = where, before.get(where)
                else:
                    out.append((name, decide(current, previous, page), count))
                    previous = current
                current, name, count = page, digest, n
            if out:
                yield pd.DataFrame(out, columns=["digest", "shared", "n"])
        if current is not None:
            yield pd.DataFrame([(name, decide(current, previous, behind.get(part)), count)], columns=["digest", "shared", "n"])

    return checkpointed(sorted_.mapInPandas(compare, "digest string, shared array<boolean>, n long"))


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url and the main text of every page, from its whole html.

    Blocks are joined by a blank line; character references are decoded and
    white space inside a block becomes one space.  An undecided block stays if
    the nearest neighbour does not share it, or if the page has no neighbour
    with other lines in its host.  Null or empty html, and pages where nothing
    stays, give an empty text.  Pages without an address form one host.
    Repeated rows and copies get equal texts; an empty table stays empty;
    other columns play no part.
    """
    decided = neighbour_lines(parsed_pages(pages, page_id, url, html, False).select("host", "path", "digest", "lines"))
    texts = parsed_pages(pages, page_id, url, html, True).select("page_id", "url", "digest", "texts", "roles")
    with_shared = attach(texts, decided, "digest", "page_id", "n")
    kept = F.expr("transform(filter(arrays_zip(texts, roles, shared), b -> b.roles = 2 OR NOT coalesce(b.shared, false)), b -> b.texts)")
    return with_shared.select("page_id", "url", F.array_join(kept, "\n\n").alias("text"))


def op10_page_text(spark, sf_dir) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
