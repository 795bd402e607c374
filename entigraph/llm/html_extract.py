"""Main text of pages by equivalence-class template deduction.

A page is a sequence of tokens: element starts and ends, told apart by their
path of tags, classes and ids, and pieces of text, told apart by path and
content.  Tokens that occur equally often on every page of a host have the same
occurrence vector; those that are many enough and on enough of the host's pages
form an equivalence class.  Vectors are as long as a host has pages, so they
are compared by a linear fingerprint: the sum, over pages, of a hash of page and
count.  It is aggregated like any sum, and no host is ever gathered.

A class is valid if its tokens stand in one order, over and over, wherever the
class occurs, and if every occurrence lies between the same two tokens of the
same class around it: so classes nest into the host's template.  The gaps
between neighbouring tokens of an occurrence are the template's slots.  Of the
template's elements the one that holds the pages' text, by its meaning or by
its share of the characters in slots, is the main region, and what is extracted are the
texts in its slots; a text that is itself a token of the template is no slot.
Constant texts only count as template if a host's slots hold more characters
within the region than they do, else its pages are copies of one another.  A
page whose host has too few pages, or that lacks the host's region, is judged
with the region of all pages, and at last by its own elements.

Elements within the region are left out by what they are (navigation, asides,
forms, scripts).  By its name an element is left out only if its name says
nothing else (``comment-list``, not ``comments-open``) and if it doesn't hold
most of the region's text on the host's pages; names of elements around the
region tell nothing.

Defined results: null, empty or text-free html gives an empty text; a null url
has a host of its own; repeated rows are pages of their own; unclosed elements
end where their parents end, an unclosed comment or script at the end of the
page; elements nested to any depth and pages of any length are read whole, in
linear time; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html as entities
import itertools
import re
from collections import defaultdict
from collections.abc import Container, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from entigraph.llm.common import SALTS, map_batches
from entigraph.plans.workspace import saved

#: A host with fewer pages has no template of its own.
LEAST_PAGES = 4
#: Share of a host's pages that a class occurs on, and its number of tokens, at least.
SUPPORT, LEAST_TOKENS = 0.5, 2
#: Share of pages on which a valid class may stand in another order or place (torn pages).
DISORDER = 0.02
#: Share of a host's characters that the main region holds, if it has a telling name or not.
NAMED_SHARE, SHARE = 0.2, 0.6
#: Share of the region's characters from which a name isn't believed that would leave them out.
DOUBTED = 0.5
#: Templates are broadcast up to this many token hashes in all.
BROADCAST_TOKENS = 2_000_000
#: The pseudo-host of all pages.
EVERY = "*"
_FLUSH = 200_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>[^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>"
    r"|<(?P<end2>/)?(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
#: A whole attribute: names within other names or within values tell nothing.
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead title tr ul".split()
)
_ENDS_PARAGRAPH = _BLOCK - frozenset("body head html legend tbody tfoot thead title tr".split())
#: Elements that a start of the same kind closes, up to the container named.
_CLOSES = {
    tag: (frozenset(same.split()), frozenset(within.split()))
    for tag, same, within in (("li", "li", "ul ol menu"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr td th", "table"), ("td", "td th", "tr table"), ("th", "td th", "tr table"), ("option", "option", "select"))
}
_PARAGRAPH, _NO_PARAGRAPH = frozenset({"p"}), _BLOCK - {"p"}
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE) for tag in _RAW}
_OUT = frozenset("script style noscript template iframe object embed svg math canvas nav aside footer header form button select option textarea input dialog menu title head audio video map".split())
_OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner sidebar sidenav menu nav navbar navigation footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist disqus reply replies respond social share sharing related recommended recommendations promo promotion sponsor sponsored subscribe subscription newsletter signup login breadcrumb breadcrumbs pagination pager widget toolbar skip search".split()
)
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar note".split())
_MAIN_WORDS = frozenset("article content post entry story main articlebody postbody".split())
#: Words that go with a name without changing what it says.
_PLAIN_WORDS = frozenset("area bar block body box btn button column col container content form group holder icon icons inner item items left link links list main module outer panel right row section site top bottom widget widgets wrap wrapper the page post posts".split())
_WORDS = re.compile(r"[a-z]+")
#: Numbers of a page rather than of its layout.
_NUMBERS = re.compile(r"(?<=[-_])\d+|\d{3,}")


# -- pages -------------------------------------------------------------------

START, END, TEXT, BREAK, VOID = range(5)
#: What an element is: bits of a token.
BLOCK, CELL, OUT, OUT_NAME, MAIN, LINK, ROOT = (1 << k for k in range(7))
_SIGN, _ONES = 1 << 63, (1 << 64) - 1
#: Positive numbers below the sign, so that signed paths stay in range.
_END_MARK, _VOID_MARK = 0x5DEECE66D2F1B3C7, 0x2545F4914F6CDD1D


class Page(NamedTuple):
    """Tokens in order: kind, path (a hash of the labels down to the element), text, bits of the element, number (none for blanks)."""

    kinds: list[int]
    paths: list[int]
    texts: list[str]
    bits: list[int]
    tokens: list[int | None]


def _signed(n: int) -> int:
    return n - (1 << 64) if n & _SIGN else n


def _hash(data: bytes, seed: int = 0) -> int:
    return _signed(xxh64_intdigest(data, seed & _ONES))


def _described(tag: str, attributes: str) -> tuple[str, int]:
    """Label of an element for its path, and its bits."""
    bits = (BLOCK if tag in _BLOCK else 0) | (CELL if tag in ("td", "th", "option") else 0) | (OUT if tag in _OUT else 0)
    bits |= (MAIN if tag in ("article", "main") else 0) | (LINK if tag == "a" else 0) | (ROOT if tag in ("html", "body") else 0)
    label, out, main = tag, False, False
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name in ("class", "id"):
            label += ("." if name == "class" else "#") + _NUMBERS.sub("", value)
            for own in value.split():
                words = set(_WORDS.findall(own))
                says_out = bool(words & _OUT_WORDS) and words <= _OUT_WORDS | _PLAIN_WORDS
                out |= says_out
                main |= not says_out and bool(words & _MAIN_WORDS)
        elif name == "role":
            bits |= (OUT if value in _OUT_ROLES else 0) | (MAIN if value in ("main", "article") else 0)
        elif name == "itemprop":
            main |= value == "articlebody"
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            bits |= OUT
    if not bits & ROOT:
        bits |= (MAIN if main and not out else 0) | (OUT_NAME if out and not main and not bits & MAIN else 0)
    return label, bits & ~MAIN if bits & OUT else bits


def _element(tag: str, attributes: str, parent: int) -> tuple[int, int]:
    """Path of an element within its parent's, and its bits."""
    label, bits = _described(tag, attributes)
    return _hash(label.encode("utf-8", "surrogatepass"), parent), bits


#: Elements met lately, for most starts repeat; those with long attributes aren't held.
_known_element = functools.lru_cache(maxsize=1 << 15)(_element)
_LONG_ATTRIBUTES = 256


def parse(html: str | None) -> Page:
    """Tokens of a page in order, with the ends that html leaves out."""
    text, at = html or "", 0
    rows: list[tuple[int, int, str, int, int | None]] = []
    stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, path, bits
    open_tags: dict[str, int] = defaultdict(int)

    def close(k: int) -> None:
        while len(stack) > k:
            tag, path, bits = stack.pop()
            open_tags[tag] -= 1
            rows.append((END, path, "", bits, path ^ _END_MARK))

    def piece(raw: str) -> None:
        if "&" in raw:
            raw = entities.unescape(raw)
        if not raw:
            return
        _, path, bits = stack[-1]
        words = " ".join(raw.split())
        if not words:
            rows.append((TEXT, path, " ", bits, None))
            return
        pad = (" " if raw[0].isspace() else "") + words + (" " if raw[-1].isspace() else "")
        rows.append((TEXT, path, pad, bits, _hash(words.encode("utf-8", "surrogatepass"), path)))

    def last(tags: frozenset[str], within: frozenset[str]) -> int:
        """Place of the innermost open element of ``tags``, if none of ``within`` stands above it."""
        if any(open_tags[t] for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in within:
                    return 0
                if stack[k][0] in tags:
                    return k
        return 0

    while m := _TOKEN.search(text, at):
        start = m.start()
        if at < start:
            piece(text[at:start])
        at = m.end()
        end, tag, attributes, end2, tag2 = m.groups()
        tag = (tag or tag2 or "").lower()
        if not tag:
            continue
        if end or end2:
            if stack[-1][0] == tag:
                close(len(stack) - 1)
            elif open_tags[tag]:
                close(last(frozenset((tag,)), frozenset()))
            continue
        if open_tags["p"] and tag in _ENDS_PARAGRAPH and (k := last(_PARAGRAPH, _NO_PARAGRAPH)):
            close(k)
        if tag in _CLOSES and (k := last(*_CLOSES[tag])):
            close(k)
        attributes = attributes or ""
        path, bits = (_known_element if len(attributes) <= _LONG_ATTRIBUTES else _element)(tag, attributes, stack[-1][1])
        if tag in _VOID:
            rows.append((BREAK if tag in ("br", "hr") else VOID, path, "", bits, path ^ _VOID_MARK))
            continue
        stack.append((tag, path, bits))
        open_tags[tag] += 1
        rows.append((START, path, "", bits, path))
        if tag in _RAW:
            found = _RAW_END[tag].search(text, at)
            at = found.end() if found else len(text)
            close(len(stack) - 1)
    if at < len(text):
        piece(text[at:])
    close(1)
    return Page(*map(list, zip(*rows))) if rows else Page([], [], [], [], [])


def token(kind: int, path: int, text: str) -> int | None:
    """Number of a token of the host's pages; none for blanks."""
    if kind == START:
        return path
    if kind == TEXT:
        return None if text.isspace() else _hash(text.strip().encode("utf-8", "surrogatepass"), path)
    return _signed((path & _ONES) ^ (_END_MARK if kind == END else _VOID_MARK))


class Held(NamedTuple):
    """Characters of an element: of all text that its tags don't leave out, without links, and of the latter what names leave in."""

    kept: int
    plain: int
    named: int


def held(page: Page, constant: Container[int] = ()) -> tuple[dict[int, Held], dict[int, tuple[int, int]], Held]:
    """Characters by path, (bits, depth) by path, and the page's own, in one pass over a stack of running sums; ``constant`` tokens don't count."""
    sums, info, stack = {}, {}, []
    kept = plain = named = out = out_name = link = 0
    for kind, path, text, bits, number in zip(*page):
        if kind == START:
            stack.append((kept, plain, named))
            out, out_name, link = out + bool(bits & OUT), out_name + bool(bits & OUT_NAME), link + bool(bits & LINK)
            if path not in info:
                info[path] = bits, len(stack)
        elif kind == END:
            out, out_name, link = out - bool(bits & OUT), out_name - bool(bits & OUT_NAME), link - bool(bits & LINK)
            a, b, c = stack.pop()
            x = sums.get(path, Held(0, 0, 0))
            sums[path] = Held(x.kept + kept - a, x.plain + plain - b, x.named + named - c)
        elif kind == TEXT and not out and not text.isspace() and not (constant and number in constant):
            size = len(text)
            kept += size
            if not link:
                plain += size
                named += 0 if out_name else size
    return sums, info, Held(kept, plain, named)


def host_of(url: Column) -> Column:
    """Authority of a URL in lower case; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


# -- classes -----------------------------------------------------------------

_PAGE = "kinds array<tinyint>, paths array<bigint>, texts array<string>, bits array<tinyint>, tokens array<bigint>"
_PAGE_TYPES = (pa.list_(pa.int8()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int8()), pa.list_(pa.int64()))


def _parsed(pages: DataFrame) -> DataFrame:
    """Written pages, each parsed once and numbered."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [parse(x) for x in batch.column(3).to_pylist()]
            offsets = pa.array([0, *itertools.accumulate(len(p.kinds) for p in done)], pa.int32())
            columns = [pa.ListArray.from_arrays(offsets, pa.array(list(itertools.chain.from_iterable(p[k] for p in done)), t.value_type)) for k, t in enumerate(_PAGE_TYPES)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["page_id", "url", "_host", *Page._fields])

    kind = dict(pages.dtypes)["page_id"]
    parsed = map_batches(pages.select("page_id", "url", "_host", "html"), work, f"page_id {kind}, url string, _host string, {_PAGE}")
    return saved(parsed.withColumn("_row", F.monotonically_increasing_id()), "parsed-pages")


def _pages_of(batch: pa.RecordBatch) -> Iterator[Page]:
    """Pages of a batch, whose columns are turned into Python values all at once: the lists have equal lengths."""
    flat, offsets = [], batch.column("kinds").offsets.to_pylist()
    for values in (batch.column(c).flatten() for c in Page._fields):
        blanks = np.flatnonzero(values.is_null().to_numpy(zero_copy_only=False)).tolist() if values.null_count else ()
        flat.append((values.fill_null(0) if blanks else values).to_numpy(zero_copy_only=False).tolist())
        for k in blanks:
            flat[-1][k] = None
    for a, b in itertools.pairwise(offsets):
        a, b = a - offsets[0], b - offsets[0]
        yield Page(*(values[a:b] for values in flat))


_SUMS = ("pages", "n", "low", "high", "place", "kept", "plain", "named")


def _statistics(parsed: DataFrame) -> DataFrame:
    """Written token statistics of hosts and of all pages.  Token 0 without a kind stands for the page itself."""
    names = ["host", "token", "kind", "bits", "depth", *_SUMS]
    types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.int64()] * len(_SUMS)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, list[int]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        for batch in batches:
            for host, row, page in zip(batch.column("_host").to_pylist(), batch.column("_row").to_pylist(), _pages_of(batch)):
                counts: dict[tuple[int, int], int] = defaultdict(int)
                first: dict[tuple[int, int], int] = {}
                chars, info, own = held(page)
                for k, (kind, t) in enumerate(zip(page.kinds, page.tokens)):
                    if t is not None:
                        counts[t, kind] += 1
                        first.setdefault((t, kind), k)
                found = [(t, kind, *(info[t] if kind == START else (0, 0)), n, first[t, kind], chars[t] if kind == START else (0, 0, 0)) for (t, kind), n in counts.items()]
                found.append((0, -1, 0, 0, 1, 0, own))
                marks: dict[int, int] = {}
                for t, kind, bits, depth, n, place, size in found:
                    mark = marks.get(n)
                    if mark is None:
                        mark = marks[n] = _hash(b"%d %d" % (row, n)) & _ONES
                    for h in (host, EVERY) if kind != TEXT else (host,):
                        key = h, t, kind, bits, depth
                        v = sums.get(key)
                        if v is None:
                            sums[key] = [1, n, mark & 0xFFFFFFFF, mark >> 32, place, *size]
                            continue
                        v[0] += 1
                        v[1] += n
                        v[2] += mark & 0xFFFFFFFF
                        v[3] += mark >> 32
                        v[4] += place
                        if kind <= START:  # only elements and pages hold characters
                            v[5] += size[0]
                            v[6] += size[1]
                            v[7] += size[2]
                if len(sums) > _FLUSH:
                    yield flush()
        yield flush()

    schema = "host string, token long, kind int, bits int, depth int, " + ", ".join(f"{c} long" for c in _SUMS)
    parts = map_batches(parsed.select("_host", "_row", *Page._fields), work, schema)
    total = [F.sum(c).alias(c) for c in _SUMS]
    return saved(parts.groupBy("host", "token", "kind", "bits", "depth").agg(*total).where("pages > 1 or kind = -1"), "tokens")


def _spread_join(rows: DataFrame, table: DataFrame, key: str, spread: Column) -> DataFrame:
    """Inner join with one row per host: salted, as one host may hold a third of the rows."""
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.hash(spread), F.lit(SALTS))).join(copies, [key, "_salt"]).drop("_salt")


def _classes(statistics: DataFrame) -> DataFrame:
    """Tokens in equivalence classes, with their host's numbers."""
    hosts = statistics.where("kind = -1").select("host", F.col("pages").alias("host_pages"), F.col("plain").alias("host_plain"), F.col("named").alias("host_named"))
    frequent = _spread_join(statistics.where("kind >= 0"), hosts.where(F.col("host_pages") >= LEAST_PAGES), "host", F.col("token"))
    frequent = frequent.where(F.col("pages") >= F.col("host_pages") * SUPPORT)
    # A text is template only where it is on all pages: copies of an article may be on many.
    frequent = frequent.where(f"kind <> {TEXT} or pages = host_pages")
    named = frequent.withColumn("class", F.xxhash64("pages", "n", "low", "high"))
    sizes = named.groupBy("host", "class").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= LEAST_TOKENS)
    return saved(named.join(sizes, ["host", "class"]), "classes")


def _templates(classes: DataFrame, invalid: DataFrame | None = None, hosts: DataFrame | None = None, slots: DataFrame | None = None) -> DataFrame:
    """host, its template's tokens and their classes in order, the main region, and the elements whose names aren't believed.

    With the results of ``_nested`` only valid classes are left, and the region
    is chosen by characters in slots; where pages are copies of each other, by
    all characters as before.
    """
    valid = classes if invalid is None else classes.join(invalid, ["host", "class"], "left_anti")
    if hosts is not None:
        valid = valid.join(hosts, "host", "left").where(f"kind <> {TEXT} or not coalesce(copies, false)").join(slots, ["host", "token"], "left")
        counted = {c: F.when(F.col("copies"), F.col(c)).otherwise(F.coalesce(F.col(f"slot_{c}"), F.lit(0))).alias(c) for c in ("kept", "plain", "named", "host_plain", "host_named")}
        valid = valid.select("host", "token", "class", "kind", "bits", "depth", "n", "pages", "place", *counted.values())
    meaning = F.when(F.col("bits").bitwiseAND(F.lit(MAIN)) != 0, 1).otherwise(0)
    any_named = F.col("host_named") > 0
    share = F.when(any_named, F.col("named")).otherwise(F.col("plain")) / F.greatest(F.when(any_named, F.col("host_named")).otherwise(F.col("host_plain")), F.lit(1))
    inside = (F.col("kind") == START) & (F.col("n") == F.col("pages")) & (F.col("bits").bitwiseAND(F.lit(OUT)) == 0)
    fits = inside & (share >= F.when(meaning == 1, NAMED_SHARE).otherwise(SHARE))
    # Of telling names the one with most text, deeper only if it holds the same; of others a tenth more or less tells nothing.
    most = F.when(meaning == 1, F.col("kept").cast("double")).otherwise(F.round(share, 1))
    region = F.max(F.when(fits, F.struct(meaning.alias("m"), most.alias("s"), "depth", "token", "plain", "kept")))
    # At most twice the tokens of a page: each is on at least half of the host's pages.
    tokens = F.sort_array(F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("at"), "token", "class")))
    suspects = F.collect_list(F.when(F.col("bits").bitwiseAND(F.lit(OUT_NAME)) != 0, F.struct("token", "plain")))
    of = valid.groupBy("host").agg(tokens.alias("t"), region.alias("r"), suspects.alias("s"))
    doubted = F.transform(F.filter("s", lambda x: x["plain"] >= DOUBTED * F.coalesce(F.col("r.plain"), F.lit(1))), lambda x: x["token"])
    return of.select("host", F.col("t.token").alias("marks"), F.col("t.class").alias("classes"), F.col("r.token").alias("region"), doubted.alias("doubted"), F.col("r.kept").alias("region_kept"))


_TEMPLATE = ("marks", "classes", "region", "doubted")


def _with_template(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Pages with their host's template: broadcast where its size is bounded, else by a salted join."""
    size = templates.agg(F.coalesce(F.sum(F.size("marks") + 8), F.lit(0))).first()[0]
    table = templates.withColumnRenamed("host", "_host")
    if size <= BROADCAST_TOKENS:
        return pages.join(F.broadcast(table), "_host", "left")
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("_salt", F.pmod(F.hash("_row"), F.lit(SALTS))).join(copies, ["_host", "_salt"], "left").drop("_salt")


class Template:
    """Place of each token in its class, and the classes' lengths."""

    def __init__(self, tokens: list[int] | None, classes: list[int] | None) -> None:
        self.place: dict[int, tuple[int, int]] = {}
        self.length: dict[int, int] = defaultdict(int)
        for t, c in zip(tokens or (), classes or ()):
            self.place[t] = c, self.length[c]
            self.length[c] += 1

    def fitted(self, page: Page) -> tuple[list[tuple[int, int] | None], dict[int, set], set[int]]:
        """For each token the slot that it stands in: the class around it and the token of that class before it, None in no class; a token of the template has its own.

        Also the slots in which each class occurs, and the classes that don't
        nest: a token out of turn, or an occurrence that doesn't end within the
        one around it.
        """
        slots, around, wrong = [], defaultdict(set), set()
        stack: list[list[int]] = []  # class and next place of each open occurrence
        for t in page.tokens:
            at = self.place.get(t)
            if at is None or at[0] in wrong:
                slots.append((stack[-1][0], stack[-1][1]) if stack else None)
                continue
            c, k = at
            if k == 0 and not any(o[0] == c for o in stack):
                around[c].add((stack[-1][0], stack[-1][1]) if stack else None)
                stack.append([c, 0])
            while stack and stack[-1][0] != c and any(o[0] == c for o in stack):
                wrong.add(stack.pop()[0])  # it reaches beyond the gap that it began in
            if not stack or stack[-1] != [c, k]:
                wrong.add(c)
                stack = [o for o in stack if o[0] != c]
            else:
                stack[-1][1] += 1
                if stack[-1][1] == self.length[c]:
                    stack.pop()
            slots.append((c, k))
        wrong.update(o[0] for o in stack)
        return slots, around, wrong


def _nested(parsed: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written results over all pages: (host, class) that aren't valid; hosts, with their characters in slots and whether constant texts outweigh them; and elements with theirs."""
    names, types = ["host", "class", "pattern", "n", "x", "y", "z"], [pa.string(), *[pa.int64()] * 6]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
        known: dict[str, Template] = {}

        def count(key: tuple, *more: int) -> None:
            for k, x in enumerate(more):
                seen[key][k] += x

        def flush() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in seen.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

        for batch in batches:
            hosts, marks, classes = (batch.column(c).to_pylist() for c in ("_host", "marks", "classes"))
            for host, own, of, page in zip(hosts, marks, classes, _pages_of(batch)):
                if not own:
                    continue
                if host not in known:
                    if len(known) > 200:
                        known.clear()
                    known[host] = Template(own, of)
                template = known[host]
                _, around, wrong = template.fitted(page)
                for c in around.keys() | wrong:
                    pattern = 0 if c in wrong else _hash(repr(sorted(around[c], key=repr)).encode())
                    count((host, c, pattern), 1, 0, 0, 0)
                chars, _, every = held(page, template.place)
                count((host, None, 0), 1, *every)
                for path in chars.keys() & template.place.keys():
                    count((host, path, None), 1, *chars[path])
                if len(seen) > _FLUSH:
                    yield flush()
        yield flush()

    found = map_batches(_with_template(parsed.select("_host", "_row", *Page._fields), templates), work, "host string, class long, pattern long, n long, x long, y long, z long")
    sums = saved(found.groupBy("host", "class", "pattern").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "z"))), "patterns")
    top = F.max(F.when(F.col("pattern") != 0, F.col("n")).otherwise(0))
    per = sums.where("class is not null and pattern is not null").groupBy("host", "class").agg(top.alias("top"), F.sum("n").alias("all"))
    invalid = saved(per.where(F.col("top") < (1 - DISORDER) * F.col("all")).select("host", "class"), "invalid")
    slots = sums.where("class is not null and pattern is null").select("host", F.col("class").alias("token"), F.col("x").alias("slot_kept"), F.col("y").alias("slot_plain"), F.col("z").alias("slot_named"))
    copies = templates.join(slots, (templates["host"] == slots["host"]) & (F.col("region") == F.col("token"))).select(templates["host"], (F.col("region_kept") >= 2 * F.col("slot_kept")).alias("copies"))
    hosts = sums.where("class is null and pattern = 0").select("host", F.col("y").alias("slot_host_plain"), F.col("z").alias("slot_host_named")).join(copies, "host", "left")
    return invalid, hosts, slots


# -- extraction --------------------------------------------------------------


def _own_region(page: Page, chars: dict[int, Held], info: dict[int, tuple[int, int]], own: Held) -> int | None:
    """The region of a page by its own elements: the first of the best meaning and share; of named ones the deepest that holds most text."""
    best = None
    for path, (bits, depth) in info.items():
        if bits & OUT:
            continue
        x, main = chars[path], bool(bits & MAIN)
        share = x.named / own.named if own.named else x.plain / max(1, own.plain)
        if share >= (NAMED_SHARE if main else SHARE):
            rank = (main, x.kept if main else round(share, 1), depth)
            if best is None or rank > best[0]:
                best = rank, path
    return best[1] if best else None


def extract(html: str | None, template: Template | None = None, region: int | None = None, fallback: int | None = None, doubted: frozenset[int] = frozenset()) -> str:
    """Texts in the slots of the main region, its blocks joined by newlines."""
    return _extracted(parse(html), template, region, fallback, doubted)


def _extracted(page: Page, template: Template | None, region: int | None, fallback: int | None, doubted: frozenset[int]) -> str:
    chars, info, own = held(page)
    chosen = next((r for r in (region, fallback) if r in info), None)
    if chosen is None:
        chosen = _own_region(page, chars, info, own)
    if chosen is None or chosen != region:  # names are judged by the page itself
        whole = chars[chosen].plain if chosen is not None else own.plain
        doubted = frozenset(p for p, (bits, _) in info.items() if bits & OUT_NAME and chars[p].plain >= DOUBTED * max(1, whole))
    slots = template.fitted(page)[0] if template is not None and template.place else None
    blocks, words, inside, out = [], [], 0, 0

    def flush() -> None:
        if text := " ".join("".join(words).split()):
            blocks.append(text)
        words.clear()

    for k, (kind, path, text, bits, number) in enumerate(zip(*page)):
        if kind == START and path == chosen:
            inside += 1
        elif kind == START and (inside or chosen is None):
            out += bool(bits & OUT) or bool(bits & OUT_NAME) and path not in doubted
        if inside or chosen is None:
            if kind == TEXT:
                constant = slots is not None and slots[k] is not None and template.place.get(number) == slots[k]
                if not out and not constant:
                    words.append(text)
            elif bits & BLOCK:
                flush()
            elif kind == BREAK or bits & CELL:
                words.append(" ")
        if kind == END and path == chosen:
            inside -= 1
        elif kind == END and (inside or chosen is None):
            out -= bool(bits & OUT) or bool(bits & OUT_NAME) and path not in doubted
    flush()
    return "\n".join(blocks)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page (columns page_id, url, html)."""
    parsed = _parsed(pages.select("page_id", "url", "html").withColumn("_host", host_of(F.col("url"))))
    statistics = _statistics(parsed)
    classes = _classes(statistics)
    drafts = saved(_templates(classes), "drafts")
    templates = saved(_templates(classes.where(F.col("host") != EVERY), *_nested(parsed, drafts.where(F.col("host") != EVERY))), "templates")
    every = drafts.where(F.col("host") == EVERY).select("region").first()  # one row
    fallback = every["region"] if every else None
    schema = f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[Template, frozenset[int]]] = {}
        for batch in batches:
            texts = []
            hosts, marks, classes, regions, doubts = (batch.column(c).to_pylist() for c in ("_host", *_TEMPLATE))
            for host, own, of, region, doubted, page in zip(hosts, marks, classes, regions, doubts, _pages_of(batch)):
                if host not in known:
                    if len(known) > 200:
                        known.clear()
                    known[host] = Template(own, of), frozenset(doubted or ())
                texts.append(_extracted(page, known[host][0], region, fallback, known[host][1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = _with_template(parsed, templates)
    return map_batches(joined.select("page_id", "url", "_host", *Page._fields, *_TEMPLATE), work, schema)
