"""Main text of web pages, by deducing the template that pages of a host share.

1. Tokens of a page are its elements, told by their path with class and id, and its blocks
   of text, told by path and text. For each host and token the vector of its counts over the
   host's pages is put into one number by a sum of hashes.
2. Tokens of a host with the same vector are an equivalence class. A class is valid if it
   stands in `share` of the host's pages and in `support` at least, has an element, and its
   tokens come in one order in all pages. Blocks of a valid class are template text, be they
   once in a page or once in each entry of a list.
3. Classes nest: a class's elements that stand once in a page are containers of the template,
   and what stands in one and in no deeper one is its slot. The deepest container that still
   has at least half of all text of the host's pages holds the main slot.
4. The main text is what stands in the main slot, without template text. Tags and names
   break ties: within the slot an article element goes before what is beside it, template
   text in it stays, and menus, headers, footers, sidebars, notices, adverts, forms and
   reader comments, whose text may vary, go. Pages without the main slot (hosts with fewer
   than `support` pages have none) are told by tags and names alone.

Both are aggregations, by host and token and by host and vector; pages of a host never meet
in one task. Pages that lack closing tags end their elements at their end, and a head that
isn't closed ends at the body or at the first element that stands in bodies only.

Null html gives an empty text, and like pages without tokens doesn't count among its host's
pages. Pages with a null or odd url share the host "". Repeated rows are handled one by one,
and count as pages of their host. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

SUPPORT, SHARE, MAIN, HOSTS, SALTS = 3, 0.5, 0.5, 20_000, 32
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<head\b[^>]*>.*?(?:</head\s*>|(?=<(?:body|div|p|article|main|section|nav|header|footer|aside|h[1-6]|table|ul|ol|form)\b)|\Z)|<(script|style|noscript|template|textarea|iframe|svg|math|select)\b[^>]*(?<!/)>.*?(?:</\1\s*>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|[^<]+|<", re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Stands between a path's elements; no name holds it.
_STEP = "\t"
_NAME = re.compile(r"[a-z]+")
_WHITE = re.compile(r"\s+")
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_MAIN = frozenset("nav header footer aside form button menu dialog fieldset object".split())
NOT_MAIN_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead"
    " comment comments disqus reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended widget toolbar pagination pager skip search".split()
)
NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Elements that may hold the main slot; others are parts of a text.
CONTAINERS = frozenset("body article main section div td center".split())
MAIN_NAMES = frozenset("article content main post entry story".split())
#: Elements that a new one of the same kind ends.
CLOSES_ITSELF = {"p": "p", "li": "li", "tr": "tr", "td": "td", "th": "th", "dt": "dt", "dd": "dd", "option": "option"}


def _names(attributes: str) -> tuple[str, set[str], str]:
    """Class and id as written, the words in them, and the role."""
    if "=" not in attributes:
        return "", set(), ""
    own, words, role = [], set(), ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        if name.lower() == "role":
            role = value
        else:
            own.append(_WHITE.sub(" ", value))
            words.update(_NAME.findall(value))
    return " ".join(own), words, role


def blocks_of(page: str) -> tuple[list[tuple[str, str, int]], list[str]]:
    """(text, path, kind) of each block, and the page's tags by path; kind 2: in an article
    or main container, 1: elsewhere, 0: in what isn't main text."""
    blocks: list[tuple[str, str, int]] = []
    tags: list[str] = []
    # open elements: tag, path, whether it or what it stands in isn't main, whether it is main
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]
    parts: list[str] = []

    def end_block() -> None:
        if parts:
            text = _WHITE.sub(" ", html.unescape("".join(parts))).strip()
            if text:
                _, path, out, main = stack[-1]
                blocks.append((text, path, 0 if out else 2 if main else 1))
            parts.clear()

    for m in _TOKEN.finditer(page):
        token = m[0]
        tag = m[3]
        if tag is None:
            if token[0] != "<" or token == "<":
                parts.append(token)
            elif token[:9].lower() == "<![cdata[":
                parts.append(html.escape(token[9:].removesuffix("]]>"), quote=False))
            continue
        tag = tag.lower()
        if tag in INLINE:
            continue
        end_block()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        own, words, role = _names(m[4])
        if tag in VOID or m[4].endswith("/"):
            continue
        if stack[-1][0] == CLOSES_ITSELF.get(tag):
            stack.pop()
        _, path, out, main = stack[-1]
        path = f"{path}{_STEP}{tag}" + (f".{own}" if own else "")
        tags.append(path)
        inside = main and tag == "header"  # an article's own head is part of it
        starts = tag in ("article", "main") or role in ("article", "main") or bool(words & MAIN_NAMES) and tag in ("div", "section", "td")
        bad = not inside and (tag in NOT_MAIN or role in NOT_MAIN_ROLES or bool(words & NOT_MAIN_NAMES) and not (starts and tag in ("article", "main")))
        if tag in ("html", "body"):
            bad = False
        stack.append((tag, path, out or bad, (main or starts) and not out))
    end_block()
    return blocks, tags


def _host(c):
    return F.lower(F.coalesce(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]+)", 1), F.lit("")))


def _parent(path: str) -> str:
    return path.rpartition(_STEP)[0]


def _tag(path: str) -> str:
    return path.rpartition(_STEP)[2].partition(".")[0]


def _key(token: str) -> int:
    return xxhash.xxh3_64_intdigest(token) - (1 << 63)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, vector, single, at, depth, chars, pages) for each token of each page:
    at its place among the page's tokens, depth its element's (0: a block, or what holds no
    main slot), chars the text in its elements; and a row without token for the page."""
    for batch in slices(batches, "html"):
        out: list[tuple] = []
        for host, key, page in zip(*(batch.column(c).to_pylist() for c in ("host", "key", "html"))):
            blocks, tags = blocks_of(page or "")
            if not tags and not blocks:
                continue
            counts: dict[str, int] = {}
            for token in [*tags, *(f"{path}>{text}" for text, path, _ in blocks)]:
                counts[token] = counts.get(token, 0) + 1
            chars: dict[str, int] = {}
            for text, path, _ in blocks:
                while path:
                    chars[path] = chars.get(path, 0) + len(text)
                    path = _parent(path)
            places = {path: k for k, path in reversed(list(enumerate(tags)))}
            elements = set(tags)
            out.append((host, None, 0, False, 0, 0, sum(len(text) for text, *_ in blocks), 1))
            for token, n in counts.items():
                element = token in elements
                depth = token.count(_STEP) if element and _tag(token) in CONTAINERS else 0
                at = places[token] if element else -1  # blocks keep their elements' order
                out.append((host, _key(token), _key(f"{key} {n}") >> 20, n == 1, at, depth, chars.get(token, 0) if element else -1, 0))
        if out:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["host", "token", "vector", "single", "at", "depth", "chars", "pages"])


def _main_text(page: str, fixed: set[int], main: int | None) -> str:
    blocks, tags = blocks_of(page)
    slot = next((path for path in dict.fromkeys(tags) if _key(path) == main), None) if main is not None else None
    if slot is not None:
        within = [b for b in blocks if b[2] and (b[1] == slot or b[1].startswith(slot + _STEP))]
        if within:
            # an article that the slot holds or stands in goes before what is beside it
            if any(kind == 2 for *_, kind in within):
                within = [b for b in blocks if b[2] == 2]
            return " ".join(text for text, path, kind in within if kind == 2 or _key(f"{path}>{text}") not in fixed)
    best = max((kind for *_, kind in blocks), default=0)
    return " ".join(text for text, path, kind in blocks if kind and kind == best and (kind == 2 or _key(f"{path}>{text}") not in fixed))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = []
        for page, fixed, main in zip(batch.column("html"), batch.column("fixed"), batch.column("main")):
            texts.append(_main_text(page.as_py() or "", set(fixed.as_py() or ()), main.as_py()))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def classes(pages: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """(host, vector, n, tokens, all_chars) for each valid class: in how many pages it stands,
    its tokens (token, at, last, single, depth, chars; blocks have chars -1) in page order, and
    the text of all pages of the host. A host's classes have together at most 1 / share times
    as many tokens as its pages have on average."""
    rows = pages.filter("html is not null").select(_host(F.col("url")).alias("host"), F.xxhash64("page_id", "url", "html").alias("key"), "html")
    shape = "host string, token long, vector long, single boolean, at int, depth int, chars long, pages long"
    seen = rows.mapInArrow(_tokens, shape).groupBy("host", "token").agg(
        F.count("*").alias("n"), F.sum(F.col("vector").cast("decimal(20,0)")).alias("vector"), F.min("single").alias("single"),
        F.min("at").alias("at"), F.max("at").alias("last"), F.max("depth").alias("depth"), F.sum("chars").alias("chars"), F.sum("pages").alias("pages"),
    )
    seen = written(seen.filter((F.col("n") >= support) | F.col("token").isNull()))
    hosts = seen.filter("token is null").select("host", "pages", F.col("chars").alias("all_chars"))
    often = seen.filter("token is not null").join(hosts.withColumnRenamed("pages", "of"), "host").filter(F.col("n") >= share * F.col("of"))
    own = often.groupBy("host", "vector").agg(F.first("n").alias("n"), F.first("all_chars").alias("all_chars"), F.array_sort(F.collect_list(F.struct("at", "last", "token", "single", "depth", F.when(F.col("at") < 0, -1).otherwise(F.col("chars")).alias("chars")))).alias("tokens"))
    # one order: who comes first by the earliest place comes first by the latest too
    elements = F.filter("tokens", lambda t: t["at"] >= 0)
    later = F.slice(elements, 2, F.greatest(F.size(elements) - 1, F.lit(0)))
    ordered = F.forall(F.zip_with(F.slice(elements, 1, F.size(later)), later, lambda a, b: a["last"] <= b["last"]), lambda x: x)
    return own.filter((F.size(elements) > 0) & ordered)


def templates(pages: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """(host, fixed, main): the template's blocks of text, and the element of its main slot."""
    own = classes(pages, support, share).select("host", "all_chars", F.filter("tokens", lambda t: t["at"] < 0)["token"].alias("texts"), F.filter("tokens", lambda t: t["single"] & (t["depth"] > 0) & (t["chars"] > 0) & (t["chars"] >= MAIN * F.col("all_chars"))).alias("holders"))
    deepest = F.array_max(F.transform("holders", lambda t: F.struct(t["depth"].alias("depth"), t["token"].alias("token"))))
    return own.groupBy("host").agg(F.flatten(F.collect_list("texts")).alias("fixed"), F.max(deepest).alias("main")).select("host", "fixed", F.col("main.token").alias("main"))


def extract(pages: DataFrame, support: int = SUPPORT, share: float = SHARE, hosts: int = HOSTS, salts: int = SALTS) -> DataFrame:
    """Per row page_id, url, text and n_chars (code points of text).

    support: pages from which a host has a template; share: of a host's pages that a class
    stands in at least; hosts: templates up to which they are
    broadcast, so that pages stay where they are read. Beyond it pages are shuffled by host
    and one of `salts` numbers, with a copy of the template for each, so that a large host
    is dealt over several tasks.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    rows = pages.withColumn("host", _host(F.col("url")))
    found = written(templates(pages, support, share))
    if found.count() <= hosts:
        joined = rows.join(F.broadcast(found), "host", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")
        joined = rows.withColumn("salt", salt).join(salted, ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "fixed", "main").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
