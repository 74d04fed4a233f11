"""Main text of web pages, with the templates of their site removed.

A page is read into a flat list of elements in document order. Every element's
subtree is hashed (tag, class and id, texts and subtrees inside). Spark counts, per
host, on how many different pages a subtree occurs; what recurs on at least
``LEAST`` pages, however many the host has, is its template and is deleted, along with elements that say by tag, role or class that they are menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles or reader comments.
What is left of the article (else the main element, else the body) is the text. A
class like "header" does not count on an element that holds most of an article.

Paragraphs, headings and inline elements inside an article are never counted: a
passage that many articles quote is content. Pages with equal content count once,
so copies of an article do not turn it into a template.

Subtrees are counted before anything moves, one row for each different (host,
subtree, page content) of a batch, so a large host is summed in parts. Templates
are broadcast as one sorted array if there are at most ``BROADCAST_TEMPLATES``;
else every page is joined with its host's.

Defined cases: null and empty html give an empty text; a null or odd url is the
host ''; broken, nested or unclosed markup is read leniently; equal rows are all
returned; an empty table gives an empty table; extra columns are ignored; a page
of any length is read whole.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urna.llm.common import stage

#: A template is on at least so many different pages of a host.
LEAST = 5
BROADCAST_TEMPLATES = 1_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text, whatever it looks like.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of the text.
OUT = frozenset(
    "head title script style noscript template nav header footer aside form button input select textarea iframe svg canvas "
    "object dialog menu xmp noembed noframes".split()
)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words of a class or id that mark the same.
OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|alerts?|newsletter|"
    r"subscribe\w*|subscription|sidebars?|side-?bar|menus?|nav|navbar|navigation|topnav|breadcrumbs?|footers?|headers?|masthead|"
    r"comments?|commentlist|disqus|replies|related|share|sharing|social|popups?|modals?|login|signup|pagination|pager|widgets?|"
    r"skip-?link)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Of these, names that a site also gives to the box around an article's text.
AROUND_NAMES = re.compile(r"(?:^|[\s_-])(?:headers?|footers?|notices?|alerts?|banner\w*|promo\w*|sponsor\w*|widgets?|modals?|popups?)(?:$|[\s_-])", re.IGNORECASE)
#: Inside an article these are content, however often they recur.
PROSE = frozenset(
    "p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr tbody thead tfoot caption figcaption a abbr b bdi bdo big cite code del dfn em "
    "font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br hr img wbr article main".split()
)
#: Elements that a new one of the key closes, up to the elements that hold them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: A new block closes an open paragraph, unless one of these lies between.
ENDS_P = BLOCK - frozenset("html body li dd dt td th tr tbody thead tfoot caption legend option optgroup summary".split())
HOLDS_P = frozenset("button object td th caption table".split())

_TOKEN = re.compile(
    r"<(?:!--(?:.*?(?:--!?>|\Z))|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[!?/][^>]*+>)", re.DOTALL
)
_CUT = re.compile(r"</?[a-zA-Z!]")
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Page:
    """A page's elements in document order, their parents and subtree hashes, and its texts.

    ``pieces`` holds (element, text) in order; a text of None is a block's edge.
    """

    def __init__(self, source: str):
        self.tags, self.parents, self.attrs = ["#"], [-1], [{}]
        self.hashes: list[int] = [0]
        self.pieces: list[tuple[int, str | None]] = []
        self._sums = {0: xxhash.xxh64()}
        self._open = [0]
        place = 0
        while True:
            at = source.find("<", place)
            if at < 0:
                break
            token = _TOKEN.match(source, at)
            if token is None:
                if _CUT.match(source, at) and source.find(">", at) < 0:
                    # A tag that the end of the page cuts off.
                    self._text(source[place:at])
                    place = len(source)
                    break
                # A lone sign is text.
                self._text(source[place : at + 1])
                place = at + 1
                continue
            if at > place:
                self._text(source[place:at])
            place = token.end()
            tag = token["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if token["end"]:
                self._close(tag)
                continue
            self._start(tag, token["attrs"])
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE).search(source, place)
                inside = source[place : end.start() if end else len(source)]
                if inside:
                    self._sums[self._open[-1]].update(inside.encode())
                place = len(source) if end is None else source.find(">", end.start()) + 1 or len(source)
                self._close(tag)
        if place < len(source):
            self._text(source[place:])
        while self._open:
            self._pop()

    def _text(self, text: str) -> None:
        own = self._open[-1]
        self.pieces.append((own, text))
        plain = text.strip()
        if plain:
            self._sums[own].update(plain.encode())

    def _start(self, tag: str, attrs: str) -> None:
        opened = self._open
        if tag in ENDS_P:
            for depth in range(len(opened) - 1, 0, -1):
                held = self.tags[opened[depth]]
                if held == "p":
                    self._pop_to(depth)
                if held == "p" or held in HOLDS_P:
                    break
        if tag in CLOSES:
            ends, stops = CLOSES[tag]
            outer = None
            for depth in range(len(opened) - 1, 0, -1):
                held = self.tags[opened[depth]]
                if held in stops:
                    break
                if held in ends:
                    outer = depth
            if outer is not None:
                self._pop_to(outer)
        number = len(self.tags)
        self.tags.append(tag)
        self.parents.append(opened[-1])
        found = {}
        if attrs.strip():
            for name, a, b, c in _ATTR.findall(attrs):
                found.setdefault(name.lower(), a or b or c)
        self.attrs.append(found)
        self.hashes.append(0)
        self._sums[number] = xxhash.xxh64(f"<{tag} {found.get('class', '')} {found.get('id', '')}>".encode())
        if tag in BLOCK:
            self.pieces.append((number, None))
        elif tag == "br":
            self.pieces.append((number, " "))
        opened.append(number)
        if tag in VOID:
            self._pop()

    def _close(self, tag: str) -> None:
        for depth in range(len(self._open) - 1, 0, -1):
            if self.tags[self._open[depth]] == tag:
                self._pop_to(depth)
                return

    def _pop_to(self, depth: int) -> None:
        while len(self._open) > depth:
            self._pop()

    def _pop(self) -> None:
        number = self._open.pop()
        self.hashes[number] = value = self._sums.pop(number).intdigest()
        if self._open:
            self._sums[self._open[-1]].update(value.to_bytes(8, "little"))
        if self.tags[number] in BLOCK:
            self.pieces.append((number, None))

    def _inherit(self, own: list[bool]) -> list[bool]:
        for i in range(1, len(own)):
            if not own[i] and own[self.parents[i]]:
                own[i] = True
        return own

    def countable(self) -> set[int]:
        """Hashes of the subtrees that may be a template."""
        inside = self._inherit([t in ("article", "main") for t in self.tags])
        return {h for h, t, i in zip(self.hashes, self.tags, inside, strict=True) if t not in ("#", "html", "body", "article", "main") and not (i and t in PROSE)}

    def _most_of_an_article(self) -> list[bool]:
        """Elements inside an article that hold more than half of its text."""
        size, holder = [0] * len(self.tags), [0] * len(self.tags)
        for i, piece in self.pieces:
            size[i] += len(piece.strip()) if piece else 0
        for i in range(len(size) - 1, 0, -1):
            size[self.parents[i]] += size[i]
        for i in range(1, len(size)):
            outer = self.parents[i]
            holder[i] = outer if self.tags[outer] in ("article", "main") else holder[outer]
        return [h > 0 and 2 * size[i] > size[h] for i, h in enumerate(holder)]

    def _says_out(self, i: int, most: list[bool]) -> bool:
        tag, attrs = self.tags[i], self.attrs[i]
        if tag in OUT:
            return True
        if not attrs or tag in ("html", "body", "article", "main", "#"):
            return False
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        if most[i]:
            # A "post-header" around the body of an article is its body.
            names = AROUND_NAMES.sub(" ", names)
        return "hidden" in attrs or (attrs.get("role") or "").lower() in OUT_ROLES or (names != " " and OUT_NAMES.search(names) is not None) or "comment" in (attrs.get("itemtype") or "").lower()

    def text(self, templates: set[int]) -> str:
        """The page's main text without the given subtrees."""
        inside = self._inherit([t in ("article", "main") for t in self.tags])
        out, most = [False] * len(self.tags), self._most_of_an_article()
        for i in range(1, len(out)):
            known = self.hashes[i] in templates and self.tags[i] not in ("html", "body", "article", "main") and not (inside[i] and self.tags[i] in PROSE)
            out[i] = out[self.parents[i]] or known or self._says_out(i, most)
        root = next((t for t in ("article", "main") if any(x == t and not o for x, o in zip(self.tags, out, strict=True))), None)
        chosen = self._inherit([root is None or t == root for t in self.tags])
        blocks, own = [], []
        for i, piece in self.pieces:
            if piece is None:
                if own:
                    blocks.append("".join(own))
                    own = []
            elif chosen[i] and not out[i]:
                own.append(piece)
        blocks.append("".join(own))
        cleaned = (" ".join(entities.unescape(b).split()) for b in blocks)
        return "\n".join([b for b in cleaned if b])


def _host_key(host, subtree: int) -> int:
    """One number for a subtree of a host."""
    return xxhash.xxh64_intdigest(subtree.to_bytes(8, "little"), xxhash.xxh64_intdigest((host or "").encode()) & 0xFFFFFFFF)


def _signed(values) -> np.ndarray:
    return np.array(list(values), dtype=np.uint64).view(np.int64)


def templates(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(host, key) of every template, as a written table; ``pages`` has host and html."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found: set[tuple] = set()
            for host, source in zip(frame["host"], frame["html"], strict=True):
                if not isinstance(source, str) or not source:
                    continue
                page = Page(source)
                whole = next((h for h, t in zip(page.hashes, page.tags, strict=True) if t in ("article", "main", "body")), page.hashes[0])
                found |= {(host, _host_key(host, h), whole) for h in page.countable()}
            rows = list(found)
            if not rows:  # nothing but null, empty or plain pages
                continue
            yield pd.DataFrame(
                {
                    "host": [r[0] for r in rows], "key": _signed(r[1] for r in rows),
                    "page": _signed(r[2] for r in rows),
                }
            )

    seen = pages.select("host", "html").mapInPandas(run, "host string, key bigint, page bigint")
    counted = seen.distinct().groupBy("host", "key").agg(F.count("*").alias("n"))
    return stage(counted.where(F.col("n") >= least).select("host", "key"))


def extract(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    read = pages.select("page_id", "url", "html", host.alias("host"))
    found = templates(read, least)
    small = found.count() <= BROADCAST_TEMPLATES
    if small:
        keys = np.sort(found.select("key").toPandas()["key"].to_numpy(np.int64))
        shared = pages.sparkSession.sparkContext.broadcast(keys)
        ready = read.withColumn("templates", F.lit(None).cast("array<bigint>"))
    else:
        shared = None
        ready = read.join(found.groupBy("host").agg(F.collect_list("key").alias("templates")), "host", "left")

    @F.pandas_udf("string")
    def main_text(columns: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = set(shared.value.tolist()) if shared is not None else None
        for hosts, sources, templates_ in columns:
            texts = []
            for host_, source, own in zip(hosts, sources, templates_, strict=True):
                if not isinstance(source, str) or not source:
                    texts.append("")
                    continue
                page = Page(source)
                keys_ = known if known is not None else set(own) if own is not None else set()
                hit = set()
                for h in set(page.hashes):
                    key = _host_key(host_, h)
                    if key - (key >> 63 << 64) in keys_:
                        hit.add(h)
                texts.append(page.text(hit))
            yield pd.Series(texts, dtype=object)

    # Ids and urls stay in Spark: beside a null, pandas would make floats of ids.
    done = ready.select("page_id", "url", main_text("host", "html", "templates").alias("text"))
    return done.withColumn("n_chars", F.char_length("text").cast("bigint"))
