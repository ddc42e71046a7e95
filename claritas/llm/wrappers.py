"""HTML extraction by union-free wrappers (after Crescenzi et al., RoadRunner, 2001).

A page is its token stream (html_tokens.py). A wrapper of a host has, for every element path, a union-free
expression over what stands in it: items in order, each once, optional, or repeated; a text item is
template wording while all pages agree on it and a text slot once two differ. The expression of a path
is inferred by aligning page after page: equal neighbours fold into a repeated item, what one side lacks
becomes optional, texts that differ become slots. Aligning is done per task on the pages of each host and
then between the wrappers of tasks, first in a fixed number of salted parts; so a host with a third of
all pages is never gathered. A page whose expressions the wrapper accepts already costs no alignment.

Extraction applies the wrapper of the host to each page. A box (div, section, list, table, details) of the
main region whose texts are all template wording is a menu, notice or advert, whatever its class, and goes;
a box with a slot stays whole, and so do headings and paragraphs that stand in the flow of the text, however
many pages share them. The main region is the outermost article (else main, else body) outside of page
furniture that is known by element, role, class or id: menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles, reader comments. A wording is template only where `LEAST_PAGES` different pages hold
that very text in that place: each text item carries the marks of so many pages. So on hosts with fewer
pages every text outside known furniture is kept. In a body without article or main, blocks that are mostly
links are menus.

Items are aligned by a longest common subsequence in bit-parallel blocks: memory grows with a page, not with
its square, and 20,000 alternating items take seconds.

A block is the text between two block-level tags; references are decoded, white space becomes one space.

Nulls: a null html gives an empty text; a null url is a host of its own. Repeated rows each get a row.
"""

from __future__ import annotations

import hashlib
import html
import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claritas.llm.html_tokens import INLINE, stream
from claritas.operators.subsequence import lcs_positions
from claritas.session import written

LEAST_PAGES = 8
SALTS = 32
SHIP_BYTES = 32 << 20
SPACE = re.compile(r"\s+")
MAIN = re.compile(r"<(?:article|main)\b", re.I)

# Fixed lists: page furniture by element, by role, and by a word of class or id.
FURNITURE = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "button", "select", "option", "textarea", "iframe",
             "object", "svg", "canvas", "dialog", "menu", "head", "title", "input", "audio", "video", "map"}
# Furniture that stands inside a line of text and does not end its block.
INVISIBLE = {"script", "style", "noscript", "template", "button", "select", "option", "input", "iframe", "object", "svg", "canvas", "audio", "video", "map"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "toolbar"}
WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
         "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc",
         "sidebar", "sidebars", "aside", "related", "recommended", "widget", "widgets", "share", "sharing", "social", "newsletter", "subscribe", "signup", "login",
         "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "disclaimer",
         "comment", "comments", "commentlist", "respond", "replies", "reply", "disqus", "footer", "copyright", "masthead", "skip", "hidden"}
BOXES = {"div", "section", "ul", "ol", "dl", "table", "details"}
NAME = re.compile(r"[A-Za-z]+")


def is_furniture(tag: str, attributes: dict[str, str], inside_main: bool, by_name: bool = True) -> bool:
    if tag in FURNITURE or (tag == "header" and not inside_main):
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if attributes.get("role", "").lower() in ROLES:
        return True
    if tag in ("body", "html", "main") or (tag == "article" and not inside_main and "comment" not in attributes.get("class", "").lower()):
        return False
    if not by_name and not inside_main:
        return False
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return any(w.lower() in WORDS for w in NAME.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", names)))


def named(attributes: dict[str, str]) -> str:
    """What a class (else an id) adds to the name of an element; long numbers in it differ from page to page."""
    name = attributes.get("class") or attributes.get("id") or ""
    return "".join(f".{w}" for w in re.sub(r"\d{2,}", "", name).split())


class Page:
    """Blocks of a page outside furniture, and what stands in each element path."""

    def __init__(self, source: str):
        self._read(source, True)
        if not any(b[0] for b in self.blocks) and MAIN.search(source):
            self._read(source, False)  # a class or id around the whole article looked like furniture

    def _read(self, source: str, by_name: bool) -> None:
        # region (article, main or ""), path, text, characters in links, numbers of the boxes around it
        self.blocks: list[tuple[str, str, str, int, tuple[int, ...]]] = []
        self.inside: dict[str, list[tuple[str, str]]] = {"": []}  # path -> (item, text) in order
        path, regions, boxes, hidden, links = [""], [], [], 0, 0
        n_boxes = 0
        opened: list[tuple[str, bool]] = []
        words: list[str] = []
        linked = 0

        def end_block() -> None:
            nonlocal linked
            text = SPACE.sub(" ", html.unescape("".join(words))).strip()
            if text:
                region = "article" if "article" in regions else "main" if "main" in regions else ""
                self.blocks.append((region, path[-1], text, linked, tuple(b for b in boxes if b)))
                self.inside[path[-1]].append(("#text", text))
            words.clear()
            linked = 0

        for kind, what, attributes in stream(source):
            if kind == "text":
                if not hidden:
                    words.append(what)
                    linked += len(what) if links else 0
            elif kind == "break":
                words.append(" ")
            elif kind == "open":
                furniture = hidden > 0 or is_furniture(what, attributes, any(regions), by_name)
                inline = what in INLINE and not furniture
                if not (inline or hidden or (furniture and what in INVISIBLE)):
                    end_block()
                if furniture:
                    if not hidden:
                        self.inside[path[-1]].append((f"!{what}", ""))
                    hidden += 1
                elif inline:
                    links += what == "a"
                else:
                    self.inside[path[-1]].append((what, ""))
                    path.append(f"{path[-1]}/{what}{named(attributes)}")
                    self.inside.setdefault(path[-1], [])
                    n_boxes += what in BOXES
                    boxes.append(n_boxes if what in BOXES else 0)
                    role = "article" if what == "article" or attributes.get("itemprop", "").lower() == "articlebody" else "main" if what == "main" or attributes.get("role", "").lower() == "main" else None
                    regions.append(role)
                opened.append((what, furniture))
            else:
                _, furniture = opened.pop()
                if furniture:
                    hidden -= 1
                elif what in INLINE:
                    links -= what == "a"
                else:
                    end_block()
                    path.pop()
                    regions.pop()
                    boxes.pop()
        end_block()

    def wordings(self) -> dict[str, list[str]]:
        """Per path, for each of its texts in order: the wording of the repeated item that it belongs to."""
        out: dict[str, list[str]] = {}
        for path, items in self.inside.items():
            texts = out.setdefault(path, [])
            for item, run in itertools.groupby(items, key=lambda x: x[0]):
                if item == "#text":
                    marks = [_mark(text) for _, text in run]
                    whole = marks[0]
                    for mark in marks[1:]:
                        whole = _mark(whole + mark)
                    texts += [whole] * len(marks)
        return out

    def shape(self) -> str:
        return hashlib.md5(json.dumps({p: [i for i, _ in items] for p, items in self.inside.items()}).encode()).hexdigest()


def _mark(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()[:16]


def _held(a: list[str], b: list[str]) -> list[str]:
    """Marks of both, LEAST_PAGES at most: enough to know that there are so many."""
    return sorted({*a, *b})[:LEAST_PAGES]


def folded(items: list[tuple[str, str]], page: str = "") -> list[list]:
    """[item, least, most, wording, marks of pages with this wording]: equal neighbours become one repeated item
    and their texts, in order, its wording."""
    out: list[list] = []
    for item, text in items:
        mark = _mark(text) if item == "#text" else ""
        if out and out[-1][0] == item:
            out[-1][2] = 2
            out[-1][3] = _mark(out[-1][3] + mark) if mark else ""
        else:
            out.append([item, 1, 1, mark, [page] if mark else []])
    return out


def align(a: list[list], b: list[list]) -> list[list]:
    """The union-free expression of both: a longest common run of items, the rest optional."""
    names = [x[0] for x in b]
    pairs, at = [], 0
    for i in sorted(lcs_positions([x[0] for x in a], names)):
        at = names.index(a[i][0], at)  # any place will do: no common item can lie between two pairs
        pairs.append((i, at))
        at += 1
    out: list[list] = []

    def both(x: list, y: list) -> list:
        """Wording and its pages."""
        return [x[3], _held(x[4], y[4])] if x[3] == y[3] else [None, []]

    def add(new: list) -> None:
        if out and out[-1][0] == new[0]:  # what would be two neighbours is one repeated item
            out[-1][1:] = [min(out[-1][1], new[1]), 2, *both(out[-1], new)]
        else:
            out.append(new)

    i = j = 0
    for x, y in [*pairs, (len(a), len(b))]:
        for one in [*a[i:x], *b[j:y]]:
            add([one[0], 0, *one[2:]])
        if x < len(a):
            add([a[x][0], min(a[x][1], b[y][1]), max(a[x][2], b[y][2]), *both(a[x], b[y])])
        i, j = x + 1, y + 1
    return out


class Wrapper:
    def __init__(self, rules: dict | None = None):
        self.rules: dict[str, list[list]] = rules or {}

    def take(self, page: Page) -> None:
        mark = _mark("\n".join(b[2] for b in page.blocks))
        for path, items in page.inside.items():
            new = folded(items, mark)
            old = self.rules.get(path)
            if old is None:
                self.rules[path] = new
            elif old != new and not self._accepts(old, new):
                self.rules[path] = align(old, new)

    @staticmethod
    def _accepts(old: list[list], new: list[list]) -> bool:
        """Whether aligning `new` would leave `old` as it is."""
        j = 0
        for item, least, most, wording, pages in old:
            if j < len(new) and new[j][0] == item and new[j][2] <= most and (wording is None or (wording == new[j][3] and (len(pages) >= LEAST_PAGES or set(new[j][4]) <= set(pages)))):
                j += 1
            elif least:
                return False
        return j == len(new)

    def merge(self, other: Wrapper) -> None:
        for path, rule in other.rules.items():
            self.rules[path] = align(self.rules[path], rule) if path in self.rules else rule

    def template(self) -> list[tuple[str, str]]:
        """(path, wording) of texts that enough different pages hold."""
        return sorted((p, r[3]) for p, rule in self.rules.items() for r in rule if r[0] == "#text" and r[3] and len(r[4]) >= LEAST_PAGES)

    def dump(self) -> str:
        return json.dumps(self.rules, ensure_ascii=False)

    @classmethod
    def load(cls, text: str) -> Wrapper:
        return cls(json.loads(text))


def main_text(page: Page, template: set[tuple[str, str]]) -> str:
    regions = {b[0] for b in page.blocks}
    region = "article" if "article" in regions else "main" if "main" in regions else ""
    wordings = {path: iter(marks) for path, marks in page.wordings().items()}
    every = [(*b, (b[1], next(wordings[b[1]])) in template) for b in page.blocks]
    blocks = [b[1:] for b in every if b[0] == region]
    varied = {box for *_, boxes, constant in blocks if not constant for box in boxes}
    kept = []
    for _, text, linked, boxes, _ in blocks:
        if any(box not in varied for box in boxes):
            continue
        if not region and 2 * linked > len(text):
            continue
        kept.append(text)
    return "\n\n".join(kept)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Wrappers of the hosts of a task."""
    held: dict[str, Wrapper] = {}

    def give() -> pa.RecordBatch:
        hosts = list(held)
        return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([held[h].dump() for h in hosts], pa.string())], ["host", "wrapper"])

    for batch in batches:
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held.setdefault(host, Wrapper()).take(Page(source or ""))
        if len(held) > 20_000:
            yield give()
            held.clear()
    yield give()


def _merge(part: pd.DataFrame) -> pd.DataFrame:
    out = Wrapper()
    for text in sorted(part["wrapper"]):
        out.merge(Wrapper.load(text))
    return part.iloc[:1].assign(wrapper=out.dump())


def host_of(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[^:/?#]*:?//([^/?#]*)", 1), F.lit("")))


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper) from (host, html)."""
    folded_ = pages.select("host", "html").mapInArrow(_fold, "host string, wrapper string")
    salted = folded_.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    once = salted.groupBy("host", "salt").applyInPandas(_merge, "host string, wrapper string, salt bigint")
    return once.groupBy("host").applyInPandas(_merge, "host string, wrapper string, salt bigint").drop("salt")


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [(h, json.dumps(t)) for h, t in ((h, Wrapper.load(w).template()) for h, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())) if t]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.string())], ["known", "template"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: tuple = (None, set())
    for batch in batches:
        texts = []
        n = batch.num_columns
        for source, template in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist()):
            if template != last[0]:
                last = (template, {tuple(t) for t in json.loads(template)} if template else set())
            texts.append(main_text(Page(source or ""), last[1]))
        yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(n - 2)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*batch.schema.names[: n - 2], "text", "n_chars"])


def extract(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` of `pages` (url, html), text and n_chars of the main text. `keep` must not name these two.

    Template wording goes to all tasks where it is small; otherwise it meets the pages by host.
    """
    rows = pages.select(*[F.col(c).alias(c) for c in keep], host_of(F.col("url").cast("string")).alias("_host"), F.col("html").cast("string").alias("_html"))
    wrappers = written(infer(rows.select(F.col("_host").alias("host"), F.col("_html").alias("html"))), "wrappers")
    templates = written(wrappers.mapInArrow(_templates, "known string, template string"), "templates")
    if (templates.agg(F.sum(F.octet_length("template") + F.octet_length("known"))).first()[0] or 0) <= SHIP_BYTES:
        templates = F.broadcast(templates)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "text string, n_chars bigint"])
    joined = rows.join(templates, F.col("_host") == F.col("known"), "left")
    return joined.select(*keep, "_html", "template").mapInArrow(_extract, schema)
