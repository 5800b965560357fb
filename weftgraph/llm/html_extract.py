"""Main text of web pages by site template removal.

Each page is parsed once into its text blocks; a block knows the hashes of all element subtrees that it
lies in. Spark counts, for every host, on how many *different* pages each subtree occurs (pages with the
same article count once, so copies of an article do not make it a template), and blocks within subtrees
that recur on many pages of their host are deleted. What no page statistics can show - a page seen once,
a small host - is decided by the element itself: navigation, headers and footers of the page, asides,
forms, scripts, styles, adverts, notices, sharing bars and reader comments go by their names.

Text: the blocks of the first-level ``article`` or ``main`` elements where there are any, else of the
body. Character references are decoded, white space inside a block becomes one space, blocks are trimmed
and joined by a line feed; ``br`` is white space.

Defined results: a null or empty html, or a page without text, gives the empty text; a null url has no
host and the page stands alone; the pages of a host of fewer than LEAST_PAGES different pages lose
nothing by statistics; an article is not lost by a word of its layout; unclosed elements end where their parent ends or where HTML implies it; repeated
rows give equal rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, rows

#: A subtree is a template when it occurs on so many different pages of its host, and on so large a share.
LEAST_PAGES, LEAST_SHARE = 5, 0.3
#: Hosts of at most this many template rows in all are broadcast (16 bytes a row); beyond it they are joined.
BROADCAST_ROWS = 200_000

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary"}
DROPPED = frozenset("head nav footer aside form script style noscript template iframe object svg canvas button select option textarea input dialog menu audio video map math title xmp noembed noframes".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}}
SCOPE = frozenset("html body table ul ol dl menu article section main div select".split())
#: Words of class, id and role that name what is not the article.
NOT_ARTICLE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar aside comment comments commentlist discussion disqus replies navigation nav navbar menu breadcrumb breadcrumbs pagination pager footer masthead newsletter subscribe subscription signup login share sharing social related recommended popup modal overlay widget complementary contentinfo search toolbar".split())
CONTAINERS = frozenset({"article", "main"})
#: Elements that hold text themselves; words of layouts; names that a wrapper of the whole page may have as well.
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre figure figcaption td th tr b i em strong code".split())
DESCRIBING = frozenset("has no not with without is hide hidden".split())
WRAPPERS = frozenset("ad ads banner cookie cookies gdpr notice notices sidebar aside nav navigation navbar menu footer masthead pagination share sharing social widget toolbar search popup modal overlay subscription".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[a-z0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)")


def host_of(url: str | None) -> str | None:
    found = HOST.match(url.strip()) if url else None
    return found[1].lower() if found else None


def _name_of_extra(tag: str, attributes: str) -> str | None:
    """The word by which an element is not part of the article; None for all others.

    A class, id or role counts as a whole; on containers its parts count too ("cookie-notice", "site_footer"), unless
    it describes a layout ("has-sidebar", "no-sidebar", "content-with-toolbar").
    """
    if not attributes.strip():
        return None
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and HIDDEN.search(value)):
            return "hidden"
        if name in ("class", "id", "role") and tag not in ("html", "body"):
            for token in value.split():
                if token in NOT_ARTICLE:
                    return token
                parts = WORD.findall(token)
                if tag not in TEXT_LEVEL and tag not in CONTAINERS and DESCRIBING.isdisjoint(parts):
                    if found := [w for w in parts if w in NOT_ARTICLE]:
                        return found[-1]
    return None


class Node:
    __slots__ = ("drop", "hash", "inside", "key", "tag", "up")

    def __init__(self, tag: str, key: str, up: Node | None, drop: str | None):
        self.tag, self.key, self.up, self.drop = tag, key, up, drop
        self.inside = tag in CONTAINERS or (up is not None and up.inside)
        self.hash = blake2b(key.encode("utf-8", "replace"), digest_size=8)


def blocks(html: str | None) -> tuple[list[tuple[str, list[int]]], list[int]]:
    """(text, hashes of the subtrees around it) of each block that stays by name, in page order; hashes of all block subtrees."""
    root = Node("#root", "", None, None)
    here, nodes, found, pending = root, [], [], []

    def flush() -> None:
        if pending:
            text = " ".join("".join(pending).split())
            pending.clear()
            if text:
                owner = here
                while owner.up is not None and owner.tag not in BLOCK:
                    owner = owner.up
                found.append((text, owner))

    def close(upto: Node) -> None:
        """End all elements down to and with ``upto``."""
        nonlocal here
        while True:
            done = here
            if done.tag in BLOCK:
                flush()
            here = done.up
            here.hash.update(b"<" + done.hash.digest())
            if done is upto:
                return

    def open_(tags: frozenset | set, scope: frozenset) -> Node | None:
        at = here
        while at.up is not None:
            if at.tag in tags:
                return at
            if at.tag in scope:
                return None
            at = at.up
        return None

    def text(part: str) -> None:
        part = unescape(part) if "&" in part else part
        here.hash.update(part.encode("utf-8", "replace"))
        if not here.drop:
            pending.append(part)

    html, at = html or "", 0
    # Past the last of these nothing is a tag or a comment; looking for one would take the square of the length.
    last = max(html.rfind(">"), html.rfind("<!--"), html.rfind("<![CDATA[")) + 1
    while at < len(html):
        m = TOKEN.search(html, at) if at < last else None
        if m is None:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in ("br", "p") and open_({tag}, SCOPE) is None:
                pending.append(" ")
            elif (node := open_({tag}, frozenset() if tag in SCOPE else frozenset({"table", "article", "body"}) - {tag})) is not None:
                close(node)
            continue
        if tag == "br":
            pending.append(" ")
            continue
        if tag in BLOCK:
            flush()
        if tag in CLOSES_P and (node := open_({"p"}, SCOPE)) is not None:
            close(node)
        if tag in IMPLIED and (node := open_(IMPLIED[tag], SCOPE - {"div"} if tag == "li" else SCOPE)) is not None:
            close(node)
        if tag in VOID:
            if tag not in ("wbr",):
                pending.append(" ")
            continue
        own = "<" if tag in DROPPED or (tag == "header" and not here.inside) else _name_of_extra(tag, m[3])
        # The first article (or main) is not lost with a wrapper that only names a part of the page.
        wrapped = tag in CONTAINERS and here.drop in WRAPPERS and not any(n.tag in CONTAINERS and not n.drop for n in nodes)
        drop = own or (None if wrapped else here.drop)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        here = Node(tag, f"{tag} {' '.join(sorted(WORD.findall(m[3].lower())))}" if tag not in ("a", "html") else tag, here, drop)
        nodes.append(here)
    while here.up is not None:
        close(here)
    flush()

    chosen = [f for f in found if f[1].inside and not f[1].drop]
    if not any(n.tag in CONTAINERS and not n.drop for n in nodes):
        chosen = [f for f in found if not f[1].drop]
    ids = {id(n): int.from_bytes(n.hash.digest(), "little", signed=True) for n in nodes if n.tag in BLOCK and n.tag not in ("html", "body")}

    def around(node: Node) -> list[int]:
        out = []
        while node.up is not None:
            if id(node) in ids:
                out.append(ids[id(node)])
            node = node.up
        return out

    return [(t, around(n)) for t, n in chosen], sorted(set(ids.values()))


def _digest(found: list[tuple[str, list[int]]]) -> int:
    return int.from_bytes(blake2b("\n".join(t for t, _ in found).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def _parse(batches):
    for ids, urls, html in rows(batches, "page_id", "url", "html"):
        made = [blocks(h) for h in html]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array(urls, pa.string()),
                pa.array([host_of(u) for u in urls], pa.string()),
                pa.array([_digest(f) for f, _ in made], pa.int64()),
                pa.array([[{"t": t, "path": p} for t, p in f] for f, _ in made], pa.list_(pa.struct([("t", pa.string()), ("path", pa.list_(pa.int64()))]))),
                pa.array([s for _, s in made], pa.list_(pa.int64())),
            ],
            names=["page_id", "url", "host", "digest", "blocks", "subtrees"],
        )


PARSED = "page_id long, url string, host string, digest long, blocks array<struct<t: string, path: array<long>>>, subtrees array<long>"


def templates(parsed: DataFrame) -> DataFrame:
    """host, subtree of every subtree that recurs on its host."""
    hosted = parsed.where("host is not null").select("host", "digest", "subtrees")
    sizes = hosted.groupBy("host").agg(F.count_distinct("digest").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    seen = hosted.select("host", "digest", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.count_distinct("digest").alias("n")).where(F.col("n") >= LEAST_PAGES)
    return seen.join(sizes, "host").where(F.col("n") >= LEAST_SHARE * F.col("pages")).select("host", "subtree")


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    parsed = materialize(map_arrow(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"), _parse, PARSED), "parsed")
    recurring = materialize(templates(parsed), "templates")
    # A host has at most (subtrees of a page) / LEAST_SHARE of them, so the array is bounded by a page, not by the host.
    by_host = recurring.groupBy("host").agg(F.collect_set("subtree").alias("gone"))
    by_host = F.broadcast(by_host) if recurring.count() <= BROADCAST_ROWS else by_host
    kept = F.filter("blocks", lambda b: F.col("gone").isNull() | ~F.arrays_overlap(b["path"], F.col("gone")))
    out = parsed.select("page_id", "url", "host", "blocks").join(by_host, "host", "left")
    out = out.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["t"]), "\n").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
