"""Operator 1, main text of web pages: structure first, host suffix arrays
for what structure leaves open.

Each page is scanned once into blocks. A block inside a menu, header,
footer, sidebar, notice, advert, form or comment section, or inside hidden
or unrendered elements, goes. If the rest has an article (or, failing that, a main
region), the blocks in it are the text. An element that goes by its class or
id alone may be a wrapper: an article or main region in it is the text if the
page has none outside and less other text. Undecided are all blocks of pages
without either, and on other pages the blocks of ``min_run`` tokens or more that
lie outside the article or main region. The repetition on their host decides them:

* token streams of all pages of a host (decided blocks as well) are concatenated
  in chunks of bounded size (a host with very many pages has many chunks); one
  task builds the suffix array of a chunk by prefix doubling and finds the
  ``min_run``-token substrings that neighbouring suffixes share, with the number
  of distinct pages that hold each;
* Spark sums these counts over the chunks of a host. A token is covered if
  it lies in a substring that ``min_pages`` distinct pages hold, which is
  the case just if it lies in a longer repeated one. Covered tokens of undecided
  blocks are boilerplate; unique runs stay. Pages with the same blocks count as one.
* Beside an article or main region a unique run stays if it has ``min_run``
  tokens and the host ``min_pages`` distinct pages: of less there is no verdict.

While few blocks are undecided, only the counts of substrings in them leave the
tasks that make the suffix arrays.

Why structure comes first: with repetition alone an article that occurs on
two pages of a host, or quotes a common passage, would lose text, and menus
and adverts that differ from page to page would stay (see README).

Inside a block, white space (as Unicode defines it, so also a no-break space)
becomes one space; character references are decoded; blocks are joined in
page order by a newline.

Edge cases: null or empty html gives the empty text; a page of boilerplate
alone too. Unclosed tags, comments and scripts end with the page, stray end
tags and "<" that open no tag are text or ignored as in browsers. A null url
counts as one host without name. Repeated rows give repeated results.
Extra columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlens.llm.common import write_table

MIN_RUN, MIN_PAGES, CHUNK_TOKENS = 8, 3, 500_000
#: Undecided tokens of a table up to which the counts are looked up for them alone.
ASKED_TOKENS = 1 << 20

#: Elements that begin and end a block.
BLOCK = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure "
            "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
            "search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = set("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Elements that never hold main text.
DROP = set("audio button canvas datalist dialog fieldset footer form frameset head iframe input map menu math nav noembed noframes "
           "noscript object script search select style svg template textarea title video aside".split())
#: Words of a class, id or role that mark an element as no main text.
DROP_WORDS = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner billboard "
                 "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup "
                 "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail complementary footer contentinfo masthead topbar "
                 "comment comments commentlist disqus respond replies share sharing social related recommended recommendations "
                 "widget widgets toolbar pagination pager login search form paywall skip tooltip dialog".split())
#: The same, for elements outside an article only (an article's own header holds its title).
PAGE_WORDS = set("header banner".split())
COMMENT_WORDS = set("comment comments commentlist replies ad advert advertisement sponsored promo teaser".split())
#: A class or id like ``no-sidebar`` or ``has-menu`` says something about a wrapper's layout.
LAYOUT_WORDS = set("no not without has have with is show hide open opened closed collapsed expanded active".split())
#: What may stand beside such a word in the name of a part inside an article (``related-work`` is a chapter of it).
PART_WORDS = set("area articles bar block blocks box button buttons card cards container content header footer inner item items "
                 "left link links list main news outer page panel post posts right section site slot stories story top bottom unit "
                 "wrap wrapper".split())
ARTICLE_WORDS = set("article articlebody post entry story".split())
MAIN_WORDS = set("main content maincontent".split())

_SCAN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORDS = re.compile(r"[a-z0-9]+")
#: Regions. Held: the main region or article inside an element that goes by its name.
OPEN, HELD, MAIN, ARTICLE, NAMED, GONE = 0, 1, 2, 3, -1, -2


def _names_part(named: dict, inside: bool, words: set) -> bool:
    """Whether a class, id or role names a part that is no main text."""
    for k in ("class", "id", "role"):
        for name in named.get(k, "").split():
            ws = _WORDS.findall(name)
            hit = words.intersection(ws)
            if hit and not LAYOUT_WORDS.intersection(ws):
                if not inside or all(w in words or w in PART_WORDS or w.isdigit() for w in ws):
                    return True
    return False


def _level(tag: str, attrs: str, above: int) -> int:
    """The region that an element opens, inside the region ``above``."""
    if above == GONE or tag in DROP or (tag == "header" and above == OPEN):
        return GONE
    words, named = set(), {}
    if attrs and not attrs.isspace():
        for k, v in _ATTR.findall(attrs):
            named[k.lower()] = v.strip("\"'").lower()
        for k in ("class", "id", "role"):
            words.update(_WORDS.findall(named.get(k, "")))
        if "hidden" in named or named.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", named.get("style", "")):
            return GONE
    if tag in ("html", "body"):
        return above
    if tag == "article":
        return GONE if words & COMMENT_WORDS else HELD if above in (NAMED, HELD) else ARTICLE
    if tag == "main" or named.get("role") == "main":
        return HELD if above in (NAMED, HELD) else max(above, MAIN)
    if above == NAMED:
        return NAMED
    if _names_part(named, above in (HELD, ARTICLE), DROP_WORDS) or (above == OPEN and _names_part(named, False, PAGE_WORDS)):
        return NAMED
    if above == HELD:
        return HELD
    if named.get("itemprop") == "articlebody" or named.get("role") == "article" or tag in ("div", "section") and words & ARTICLE_WORDS:
        return ARTICLE
    return max(above, MAIN) if tag in ("div", "section") and words & MAIN_WORDS else above


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(region, text) of the blocks of a page that may hold main text, in order."""
    out: list[tuple[int, str]] = []
    if not page:
        return out
    stack: list[tuple[str, int]] = []
    level, text, at, end = OPEN, [], 0, len(page)

    def flush():
        if text:
            s = " ".join("".join(text).split())
            if s:
                out.append((level, s))
            text.clear()

    while at < end:
        m = _SCAN.search(page, at)
        stop = m.start() if m else end
        if stop > at and level >= OPEN:
            text.append(html.unescape(page[at:stop]))
        if not m:
            break
        at = m.end()
        close, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        tag = name.lower()
        if tag in BLOCK:
            flush()
        elif tag in ("br", "wbr") and tag == "br":
            text.append(" ")
        if close:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if stack[i][1] != level or any(x[1] != stack[i][1] for x in stack[i:]):
                        flush()
                    level = stack[i][1]
                    del stack[i:]
                    break
            continue
        if tag in BLOCK:  # an open paragraph or list item ends before the next
            while stack and (stack[-1][0] == "p" or stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                level = stack.pop()[1]
        if tag in RAW:
            tail = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = tail.end() if tail else end
            continue
        if tag in VOID or attrs.endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK or tag in DROP or attrs.strip():
            below = _level(tag, attrs, level)
            stack.append((tag, level))  # with the region to go back to
            if below != level:
                flush()
                level = below
    if level >= OPEN:
        flush()
    return out


def regions(found: list[tuple[int, str]], run: int = MIN_RUN) -> tuple[list[str], list[bool]]:
    """The blocks of a page that may be text, in order, and which of them are
    text by structure: those of the best region. The others are undecided."""
    size = {r: sum(len(s) for x, s in found if x == r) for r in (OPEN, HELD, MAIN, ARTICLE)}
    best = ARTICLE if size[ARTICLE] else MAIN if size[MAIN] else HELD if size[HELD] > size[OPEN] else OPEN
    # (what is held lies in an element that goes by its name)
    kept = [(s, r == best and best > OPEN) for r, s in found if r == best or r in (OPEN, MAIN) and s.count(" ") + 1 >= run]
    return [s for s, _ in kept], [firm for _, firm in kept]


def decide(found: list[tuple[int, str]], run: int = MIN_RUN) -> tuple[list[str], list[str]]:
    """(text blocks, undecided blocks) of a page: those of its best region and
    those outside it, or all of them undecided if it has none."""
    parts, firm = regions(found, run)
    return [s for s, f in zip(parts, firm) if f], [s for s, f in zip(parts, firm) if not f]


# --- repetition on a host --------------------------------------------------


def tokens(parts: list[str]) -> np.ndarray:
    words = [w for p in parts for w in p.split(" ")]
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), dtype=np.uint64, count=len(words))


def windows(t: np.ndarray, run: int) -> np.ndarray:
    """A hash of the ``run`` tokens from each position on."""
    if len(t) < run:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(len(t) - run + 1, dtype=np.uint64)
    for j in range(run):
        h = h * np.uint64(0x9E3779B97F4A7C15) + t[j:len(t) - run + 1 + j]
        h ^= h >> np.uint64(32)
    return h


def shared_prefixes(pages: list[np.ndarray], run: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the suffix array of the pages' streams, sorted by ``run`` tokens
    (prefix doubling): the hash of each group of neighbours that agree in
    them, and the number of pages in the group."""
    t = np.concatenate(pages)
    n, page = len(t), np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    ends = np.repeat(np.cumsum([len(p) for p in pages]), [len(p) for p in pages])
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64) + 1
    have = 1
    while have < run:
        step = min(have, run - have)
        nxt = np.zeros(n, dtype=np.int64)
        inside = np.flatnonzero(np.arange(n) + step < ends)
        nxt[inside] = rank[inside + step]
        rank = np.unique(rank * (n + 2) + nxt, return_inverse=True)[1].astype(np.int64) + 1
        have += step
    whole = np.flatnonzero(np.arange(n) + run <= ends)
    suffixes = whole[np.lexsort((page[whole], rank[whole]))]
    if not len(suffixes):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    first = np.r_[True, rank[suffixes[1:]] != rank[suffixes[:-1]]]
    fresh_page = first | np.r_[True, page[suffixes[1:]] != page[suffixes[:-1]]]
    counts = np.add.reduceat(fresh_page.astype(np.int64), np.flatnonzero(first))
    hashes = np.concatenate([np.r_[windows(p, run), np.zeros(min(len(p), run - 1), dtype=np.uint64)] for p in pages])
    return hashes[suffixes[first]], counts


def asked(parts: list[str], firm: list[bool], run: int) -> np.ndarray:
    """The positions of the windows that reach into an undecided block."""
    lengths = [p.count(" ") + 1 for p in parts]
    undecided = np.r_[0, np.cumsum(np.repeat(~np.array(firm, dtype=bool), lengths))]
    at = np.arange(max(0, len(undecided) - run))
    return at[undecided[at + run] > undecided[at]]


def uncovered(parts: list[str], firm: list[bool], starts, run: int, verdict: bool = True) -> str:
    """The blocks without the undecided tokens that repeated windows cover.
    Beside decided blocks, runs of less than ``run`` tokens go, and without
    a ``verdict`` all that are undecided."""
    n = sum(p.count(" ") + 1 for p in parts)
    gone = np.zeros(n + 1, dtype=np.int64)
    for s in starts:
        gone[s] += 1
        gone[min(n, s + run)] -= 1
    keep, at, out, beside = np.cumsum(gone)[:n] == 0, 0, [], any(firm)
    for p, f in zip(parts, firm):
        words = p.split(" ")
        stays = keep[at:at + len(words)]
        at += len(words)
        if f:
            out.append(p)
            continue
        if beside:
            edges = np.flatnonzero(np.diff(np.r_[False, stays, False]))
            stays = np.zeros(len(words), dtype=bool)
            for a, b in zip(edges[::2], edges[1::2]):
                stays[a:b] = verdict and b - a >= run
        left = [w for w, k in zip(words, stays) if k]
        if left:
            out.append(" ".join(left))
    return "\n".join(out)


def _pack(parts: list[str]) -> bytes:
    raw = "\n".join(parts).encode("utf-8", "surrogatepass")
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpack(packed: bytes) -> list[str]:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), "zstd", asbytes=True).decode("utf-8", "surrogatepass").split("\n")


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", min_run: int = MIN_RUN,
              min_pages: int = MIN_PAGES, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """page_id, url, text of every page."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for whole in batches:
            for a in range(0, len(whole), 256):
                b = whole.iloc[a:a + 256]
                out = []
                for host_, x in zip(b["host"], b["page"]):
                    parts, firm = regions(blocks(x), min_run)
                    packed, n = _pack(parts) if parts else None, [p.count(" ") + 1 for p in parts]
                    fp = xxhash.xxh3_64_intdigest("\n".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)
                    out.append((packed, firm, fp, sum(n), sum(m for m, f in zip(n, firm) if not f), bool(parts) and (host_, fp) not in seen))
                    if parts and len(seen) < 1 << 20:
                        seen.add((host_, fp))
                yield b[["row", "id", "url", "host"]].assign(**{c: list(x) for c, x in zip(("packed", "firm", "fp", "n", "undecided", "fresh"), zip(*out))})

    host = F.regexp_extract(F.lower(F.coalesce(F.col(f"`{url}`"), F.lit(""))), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{page_id}`").cast("string").alias("id"),
                        F.col(f"`{url}`").alias("url"), host.alias("host"), F.col(f"`{page}`").alias("page"))
    scanned = write_table(rows.mapInPandas(scan, "row long, id string, url string, host string, packed binary, firm array<boolean>, fp long, n long, "
                                                 "undecided long, fresh boolean"), "pages-scanned")
    done = scanned.where(F.col("undecided") == 0).select("id", "url", "packed")
    opened = scanned.where(F.col("undecided") > 0)

    sizes = scanned.where("fresh").select("host", "fp", "n").distinct()
    hosts = write_table(sizes.groupBy("host").agg(F.ceil(F.sum("n") / chunk_tokens).cast("int").alias("chunks"), F.count(F.lit(1)).alias("pages")), "host-chunks")
    streams = scanned.where("fresh").select("host", "fp", "packed").join(hosts.select("host", "chunks"), "host").withColumn("chunk", F.pmod(F.col("fp"), F.col("chunks")))

    def positions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row, host_, packed, firm in zip(b["row"], b["host"], b["packed"], b["firm"]):
                parts = _unpack(packed)
                at = asked(parts, list(firm), min_run)
                h = windows(tokens(parts), min_run)[at]
                yield pd.DataFrame({"row": row, "host": host_, "pos": at, "h": h.view(np.int64)})

    found = opened.select("row", "host", "packed", "firm").mapInPandas(positions, "row long, host string, pos int, h long")
    few = (opened.agg(F.sum("undecided")).first()[0] or 0) <= ASKED_TOKENS
    wanted = np.unique(found.select("h").toPandas()["h"].to_numpy(np.int64)) if few else None

    def suffix_array(group: pd.DataFrame) -> pd.DataFrame:
        hashes, counts = shared_prefixes([tokens(_unpack(p)) for p in group["packed"]], min_run)
        use = np.ones(len(hashes), dtype=bool) if wanted is None else np.isin(hashes.view(np.int64), wanted)
        if group["chunks"].iloc[0] == 1:  # no other chunk can add pages
            use &= counts >= min_pages
        return pd.DataFrame({"host": group["host"].iloc[0], "h": hashes[use].view(np.int64), "n_pages": counts[use]})

    # one shuffle for both: a chunk's copies of a page from several tasks, then the chunk
    dealt = streams.repartition("host", "chunk").dropDuplicates(["host", "chunk", "fp"])
    shared = dealt.groupBy("host", "chunk").applyInPandas(suffix_array, "host string, h long, n_pages long")
    repeated = write_table(shared.groupBy("host", "h").agg(F.sum("n_pages").alias("n")).where(F.col("n") >= min_pages).drop("n"), "host-repeats")
    starts = found.join(repeated, ["host", "h"]).groupBy("row").agg(F.collect_set("pos").alias("starts"))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "url": b["url"], "text": [
                uncovered(_unpack(p), list(f), [] if s is None else s, min_run, n >= min_pages) for p, f, s, n in zip(b["packed"], b["firm"], b["starts"], b["pages"])]})

    def whole_text(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "url": b["url"], "text": ["" if p is None else "\n".join(_unpack(p)) for p in b["packed"]]})

    result = "id string, url string, text string"
    rest = opened.join(starts, "row", "left").join(hosts.select("host", "pages"), "host").select("id", "url", "packed", "firm", "starts", "pages").mapInPandas(remove, result)
    return done.mapInPandas(whole_text, result).unionByName(rest).select(F.col("id").cast("long").alias("page_id"), "url", "text")


def html_query(pages: DataFrame) -> DataFrame:
    """Contract of ``op1``."""
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
