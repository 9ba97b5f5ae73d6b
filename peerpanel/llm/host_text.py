"""Main text of web pages: markup for what it tells, a suffix array per host for the rest.

A page is read as a stream of blocks.  Markup decides where it can: text in scripts, menus,
forms, page headers and the like is dropped; text in the article (``article``, ``main`` or an
element named like one) is kept, since articles are copied and share passages.  Of all
other text the host decides: boilerplate is what long repeated substrings cover.

The token streams of a host's pages, outside of articles, make up its suffix array, in which
suffixes that begin alike are neighbours.  For substrings of ``RUN`` tokens and more the first
``RUN`` tokens tell the neighbours, so the array is held as a table of suffixes keyed by host
and those tokens, spread over the cluster by this key: a host with a third of all pages is
many keys.  A key found in at least ``MIN_PAGES`` pages with different streams marks a repeated
substring; tokens covered by one go, unique runs stay.  Equal streams count as one
page.  Block borders are tokens too, so short blocks count with their surroundings.
"""

from __future__ import annotations

import html as html_lib
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise
from .url_rules import host_of

#: Tokens of the shortest repeated substring, and pages it must be found in.
RUN, MIN_PAGES = 8, 2
BORDER = "\x00"

# How elements are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CHROME = frozenset("nav footer aside form menu dialog button select textarea fieldset iframe object canvas audio video map head".split())
MAIN = frozenset("article main".split())
#: What a head can hold; anything else ends it, as its closing tag may be left out.
HEAD = frozenset("head base basefont bgsound link meta noframes noscript script style template title".split())
CHROME_NAMES = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices
    alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar widget footer header masthead comment comments disqus reply replies
    share sharing social related recommended newsletter subscribe signup login search pagination pager toolbar skip tags""".split())
MAIN_NAMES = frozenset("article main content post entry story".split())

#: What a name that begins with one of the above goes on with, as in ``comment-list``; ``has-sidebar`` and ``ad-free`` are no such names.
CONTAINERS = frozenset("""area banner bar block box container content feed footer form header inner items left links list menu modal nav notice panel popup
    posts right section slot thread top unit widget wrap wrapper""".split())

# Possessive all through: what an unfinished tag or an open quote has matched is not tried again, so a page is read in linear time.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|title|svg|math|xmp|noembed|noframes)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>"
    r"|</?[a-z!?][^>]*+(?:>|\Z)", re.IGNORECASE | re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_NOT_SHOWN = re.compile(r"display\s*+:\s*+none", re.IGNORECASE)


def attributes_of(text: str) -> dict[str, str]:
    """The attributes of a start tag by lower-case name; of a repeated one the first."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def named_like_chrome(name: str) -> bool:
    first, _, rest = name.partition("-")
    return name in CHROME_NAMES or (first in CHROME_NAMES and rest.rpartition("-")[2] in CONTAINERS)


def element_kind(tag: str, attributes: str, in_main: bool) -> str:
    """``chrome``, ``wrap``, ``main`` or nothing, from the tag, its class, id and role.

    ``wrap`` is chrome that an ``article`` or ``main`` inside turns off: a form, or an element outside
    of the article that is only named like chrome."""
    own = attributes_of(attributes) if attributes.strip() else {}
    hidden = "hidden" in own or own.get("aria-hidden", "").lower() == "true" or _NOT_SHOWN.search(own.get("style", "")) is not None
    if tag == "form" and not in_main:
        return "chrome" if hidden else "wrap"
    if tag in CHROME or (tag == "header" and not in_main):
        return "chrome"
    if hidden and tag not in ("html", "body"):
        return "chrome"
    names = {n for a in ("class", "id", "role") for n in own.get(a, "").lower().split()}
    if tag in MAIN:
        return "main" if not names & {"comment", "comments"} else "chrome"
    if tag in INLINE or tag in ("html", "body", "h1"):  # a name on a part of a sentence says how it looks
        return ""
    if any(named_like_chrome(n) and not (in_main and n.partition("-")[0] == "header") for n in names):
        return "chrome" if in_main else "wrap"
    return "main" if names & MAIN_NAMES else ""


#: Kinds of the start tags met so far; pages repeat them.
_KINDS: dict[tuple[str, str, bool], str] = {}


def known_kind(tag: str, attributes: str, in_main: bool) -> str:
    """``element_kind``, remembered for tags of ordinary length."""
    if len(attributes) > 200:
        return element_kind(tag, attributes, in_main)
    kind = _KINDS.get((tag, attributes, in_main))
    if kind is None:
        if len(_KINDS) >= 10_000:
            _KINDS.clear()
        kind = _KINDS[tag, attributes, in_main] = element_kind(tag, attributes, in_main)
    return kind


def page_blocks(page: str | None) -> list[tuple[str, str]]:
    """(kind, text) of a page's blocks in order; kind is ``main``, ``chrome`` or nothing.

    Character references are decoded, white space becomes one space.  Elements may be left
    open: a closing tag ends all elements inside, and a block ends an open paragraph."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    is_open: Counter = Counter()
    depth: Counter = Counter()
    parts: list[str] = []
    off = 0  # wrappers that an open article turns off

    def flush() -> None:
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                out.append(("chrome" if depth["chrome"] or depth["wrap"] > off else "main" if depth["main"] else "", text))
            parts.clear()

    def cut(to: int) -> None:
        nonlocal off
        for tag, kind in stack[to:]:
            is_open[tag] -= 1
            depth[kind] -= 1
        del stack[to:]
        if not is_open["article"] and not is_open["main"]:
            off = 0

    def end_head() -> None:
        flush()
        cut(next(k for k, (tag, _) in enumerate(stack) if tag == "head"))

    page, at = page or "", 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            if stack and stack[-1][0] == "head" and page[at:m.start()].strip():
                end_head()
            parts.append(page[at:m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if m[2]:
            if is_open[tag] > 0:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                if any(kind for _, kind in stack[k:]):
                    flush()
                cut(k)
            continue
        if is_open["head"] > 0 and tag not in HEAD:
            end_head()
        if tag in VOID:
            continue
        if tag not in INLINE and is_open["p"] > 0:  # a block ends an open paragraph
            k = len(stack) - 1
            while k >= 0 and stack[k][0] in INLINE:
                k -= 1
            if k >= 0 and stack[k][0] == "p":
                cut(k)
        kind = known_kind(tag, m[4] or "", depth["main"] > 0)
        if kind:
            flush()
        if tag in MAIN and kind == "main" and not is_open["article"] and not is_open["main"]:
            off = depth["wrap"]
        stack.append((tag, kind))
        is_open[tag] += 1
        depth[kind] += 1
    parts.append(page[at:])
    flush()
    return out


def stream(blocks: list[tuple[str, str]]) -> list[tuple[int, str]]:
    """The tokens outside of the article as (block, token), a border after each block."""
    out = []
    for k, (kind, text) in enumerate(blocks):
        if kind != "main":
            out += [(k, t) for t in text.split(" ")]
            out.append((k, BORDER))
    return out


def undecided(blocks: list[tuple[str, str]]) -> bool:
    """Whether there is text that markup alone doesn't decide."""
    return any(kind == "" for kind, _ in blocks)


def main_text(blocks: list[tuple[str, str]], repeated: list[int] | None) -> str:
    """The article and the unique runs; ``repeated``: stream positions where a repeated substring begins.

    Of a block that is not covered as a whole only covered stretches of at least ``RUN`` tokens go, so
    boilerplate does not take the first words of the text beside it along."""
    gone = {p for start in repeated or () for p in range(start, start + RUN)}
    kept, at = [], 0
    for kind, text in blocks:
        if kind == "main":
            kept.append(text)
            continue
        tokens = text.split(" ")
        if kind == "":
            covered = [at + j in gone for j in range(len(tokens))]
            if not all(covered):
                left: list[str] = []
                for hidden, run in itertools.groupby(zip(tokens, covered, strict=True), key=lambda x: x[1]):
                    words = [t for t, _ in run]
                    left += words if not hidden or len(words) < RUN else []
                kept.append(" ".join(left))
        at += len(tokens) + 1  # the border
    return " ".join(kept)


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` (the main text, empty if there is none) and ``n_chars``.

    A null html is an empty page.  Pages with a null URL, or one without a host, are the host
    ``''``.  Repeated rows all come back; they are one page to the suffix array.  Columns of
    ``pages`` with the new names are replaced.  Rows are told apart by their place in
    ``pages``, which must read the same twice (write a computed frame first).
    """
    own = pages.drop(*(c for c in ("text", "n_chars") if c != html))
    row, host, page = (free_name(own, c) for c in ("_row", "_host", "_html"))
    rows = (own.withColumnRenamed(html, page).withColumn(row, F.monotonically_increasing_id())
            .withColumn(host, host_of(F.col(page if url == html else url))))
    parts = (row, host, page)
    array = suffix_array(rows.select(*parts))
    repeated = materialise(
        array.select("host", "key", "stream").distinct().groupBy("host", "key").agg(F.count("*").alias("n"))
        .where(F.col("n") >= MIN_PAGES).select(F.col("host").alias("_at_host"), F.col("key").alias("_key")))

    def open_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                kept = [j for j, p in enumerate(part.column(page).to_pylist()) if undecided(page_blocks(p))]
                yield part.take(pa.array(kept, pa.int64()))

    at = free_name(rows, "_at")
    keep = [f for f in rows.schema.fields if f.name not in parts]
    names = [f.name for f in keep]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "text string, n_chars long"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The texts of pages; of those without a column of positions only the ones that markup decides."""
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                blocks = [page_blocks(p) for p in part.column(page).to_pylist()]
                if at in part.schema.names:
                    found = [main_text(b, where) for b, where in zip(blocks, part.column(at).to_pylist(), strict=True)]
                else:
                    kept = [j for j, b in enumerate(blocks) if not undecided(b)]
                    part, found = part.take(pa.array(kept, pa.int64())), [main_text(blocks[j], None) for j in kept]
                yield pa.RecordBatch.from_arrays([*part.select(names).columns, pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                                                 [*names, "text", "n_chars"])

    # only pages with text that markup leaves open are shuffled with their html
    left_open = rows.mapInArrow(open_only, rows.schema)
    covered = (suffix_array(left_open.select(*parts))
               .join(repeated, (F.col("host") == F.col("_at_host")) & (F.col("key") == F.col("_key")), "left_semi")
               .groupBy(F.col("row").alias("of")).agg(F.collect_list("at").alias("at")))  # at most a page's tokens
    resolved = left_open.join(covered, left_open[row] == covered["of"], "left").select(*(left_open[c] for c in (*names, page)), covered["at"].alias(at))
    return rows.select(*names, page).mapInArrow(texts, schema).unionByName(resolved.mapInArrow(texts, schema))


def suffix_array(rows: DataFrame) -> DataFrame:
    """(row, host, key, at, stream) from (row, host, html): a row per suffix of a page's stream; the key is its first ``RUN`` tokens."""

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                out: list[list] = [[], [], [], [], []]
                part = batch.slice(k, 200)
                for row, host, page in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    tokens = [t for _, t in stream(page_blocks(page))]
                    digest = xxhash.xxh64_intdigest("\x01".join(tokens)) >> 1
                    for p in range(max(1, len(tokens) - RUN + 1) if tokens else 0):
                        key = xxhash.xxh64_intdigest("\x01".join(tokens[p:p + RUN])) >> 1
                        for column, value in zip(out, (row, host or "", key, p, digest), strict=True):
                            column.append(value)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], ["row", "host", "key", "at", "stream"])

    return rows.mapInArrow(suffixes, "row long, host string, key long, at int, stream long")
