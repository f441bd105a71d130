"""Main text of web pages by template deduction over the pages of a host.

Tokens are block elements in their role (the path of block elements, with the words of class, id and role, that leads to
them) and the texts of blocks in the role of their element. A token's occurrence vector says how often it is on each page of
its host; tokens with the same vector form an equivalence class. Vectors are compared by hashed sums, which are added up before
they move. A class is frequent if it stands on at least half of the host's pages and on ``LEAST_PAGES``. Frequent classes nest
by the paths of their elements. A text is template if an element around it has its vector: it stands wherever, and as often as,
that part of the template does. So a sentence that many articles of a host share is no template, a notice with an element of its own is.

A page's text is what fills the slots between the template's tokens: all its blocks but the template's texts. A host of fewer pages has
no template. Besides, a fixed list marks elements that are no text by their name (scripts, styles, forms, navigation, asides,
footers, headers ...) or by a word of their class, id or role (adverts, notices, menus, sidebars, comments ...): what varies from page
to page in them no class can tell from text. They are left out everywhere, inline ones too, and nothing else is. Tokens move once with their
page and once to be added up; pages stay where they are unless the templates have more than ``BROADCAST_ROWS`` texts.

Null and empty pages have empty text. A page without a host shares the template of all such pages. Pages of a host with the same
bytes count once in its template, and each has its row. An unclosed script or comment runs to the end of the page. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import cut_lineage
from .base import list_array, slices, text_of

BROADCAST_ROWS = 1_000_000  # hosts, of a name and a number each, or texts of templates, of a number each
LEAST_PAGES, MOST_PAGES = 3, 0.5

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|iframe|svg|textarea|title)\b.*?(?:</(?P=raw)\s*+>|\Z)|<[!?][^>]*+>|<(?P<close>/?+)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S | re.I)
LABEL = re.compile(r"""\b(?:class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)""", re.I)
WORD = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
OTHER_NAMES = frozenset("head nav header footer aside form button select dialog menu canvas audio video object".split())
OTHER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies dialog discussion disqus footer header login masthead menu "
    "modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related replies search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
CONTENT_NAMES = frozenset("html body main article".split())


def is_other(name: str, words: list[str]) -> bool:
    return name in OTHER_NAMES or (name not in CONTENT_NAMES and any(w in OTHER_WORDS for w in words))


class Page:
    """The blocks of a page in order, without what is something else by its marks, and the block elements they stand in."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[str, int]] = []  # text, node
        self.parent, self.role = [-1], [0]  # of each node; a role is a hash of the path
        self._text: list[str] = []
        self._stack: list[tuple[str, int, bool]] = [("", 0, False)]  # name, node, whether it or an element around it is something else
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self._run(source[at : m.start()])
            at = m.end()
            if (name := m["name"]) is not None:
                self._tag(name.lower(), bool(m["close"]), m["attrs"])
        self._run(source[at:])
        self._flush()

    def _run(self, text: str) -> None:
        self._text.append(" " if self._stack[-1][2] else entities.unescape(text))

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            self._text = []
            if text:
                self.blocks.append((text, self._stack[-1][1]))

    def _pop_to(self, depth: int) -> None:
        if any(name in BLOCKS for name, _, _ in self._stack[depth:]):
            self._flush()
        del self._stack[depth:]

    def _open(self, names: set[str], within: set[str]) -> int:
        """Depth of the innermost open element of ``names`` that no element of ``within`` encloses; 0 if none."""
        for depth in range(len(self._stack) - 1, 0, -1):
            if self._stack[depth][0] in names:
                return depth
            if self._stack[depth][0] in within:
                return 0
        return 0

    def _tag(self, name: str, closes: bool, attrs: str) -> None:
        if closes:
            if depth := self._open({name}, set()):
                self._pop_to(depth)
            return
        if name == "br" or name == "hr":
            self._text.append(" ")
        if name in BLOCKS:
            self._flush()
            if depth := self._open({"p"}, BLOCKS - {"p"}):
                self._pop_to(depth)
        if name in CLOSED_BY and (depth := self._open(CLOSED_BY[name], HOLDS[name])):
            self._pop_to(depth)
        if name in VOID:
            return
        words = [w.lower() for label in LABEL.findall(attrs) for w in WORD.findall(label)] if "=" in attrs else []
        _, node, other = self._stack[-1]
        if name in BLOCKS:
            self.parent.append(node)
            self.role.append(hash_of(self.role[node], name, words))
            node = len(self.parent) - 1
        self._stack.append((name, node, other or is_other(name, words)))

    def roles(self) -> tuple[np.ndarray, ...]:
        """(role, role of the parent, depth, nodes) of each role of the page."""
        depth = np.zeros(len(self.parent), np.int64)
        for node in range(1, len(self.parent)):
            depth[node] = depth[self.parent[node]] + 1
        roles = np.array(self.role, np.int64)
        role, first, back = np.unique(roles, return_index=True, return_inverse=True)
        return role, roles[np.maximum(np.array(self.parent), 0)[first]], depth[first], np.bincount(back)

    def texts(self) -> list[tuple[int, int]]:
        """(token, role of its element) of each block."""
        return [(text_hash(self.role[node], text), self.role[node]) for text, node in self.blocks]

    def tokens(self) -> tuple[np.ndarray, ...]:
        """(token, role around it, depth, how often, whether it is a text) of each token of the page."""
        role, parent, depth, nodes = self.roles()
        texts = Counter(self.texts())
        n = np.fromiter(texts.values(), np.int64, len(texts))
        token, around = np.array(list(texts), np.int64).reshape(-1, 2).T
        return (
            np.concatenate([role, token]), np.concatenate([parent, around]), np.concatenate([depth, depth[np.searchsorted(role, around)] + 1]),
            np.concatenate([nodes, n]), np.arange(len(role) + len(n)) >= len(role),
        )

    def text(self, template: Iterable[int] | None) -> str:
        """The blocks whose tokens are not texts of the ``template``."""
        if not template:
            return "\n".join(text for text, _ in self.blocks)
        known = set(template)
        return "\n".join(text for (text, _), (token, _) in zip(self.blocks, self.texts()) if token not in known)


def text_hash(role: int, text: str) -> int:
    return int.from_bytes(blake2b(role.to_bytes(8, "little", signed=True) + text.encode(), digest_size=8).digest(), "little", signed=True)


def hash_of(parent: int, name: str, words: list[str]) -> int:
    value = parent & ((1 << 64) - 1)
    for part in (name, *sorted(set(words))):
        for byte in part.encode() + b"\0":
            value = ((value ^ byte) * 0x100000001B3) & ((1 << 64) - 1)
    return value - (1 << 64) if value >> 63 else value


def _host(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(text_of(F.col(url)), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame) -> DataFrame:
    """(host, token, parent, depth, is_text, v1, v2, pages): the tokens of each host's frequent classes, with their vectors as two sums."""
    rows = pages.select(_host("url").alias("host"), text_of(F.col("html")).alias("html")).withColumn("key", F.xxhash64("html"))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            found = [Page(h).tokens() for h in part.column("html").to_pylist()]
            lengths = np.array([len(f[0]) for f in found])
            arrays = [list_array(np.concatenate([f[i] for f in found]), lengths) for i in range(5)]
            yield pa.RecordBatch.from_arrays([part.column("host"), part.column("key"), *arrays], names=["host", "key", "token", "parent", "depth", "n", "is_text"])

    lists = "key bigint, token array<bigint>, parent array<bigint>, depth array<bigint>, n array<bigint>, is_text array<boolean>"
    schema = StructType([StructField("host", rows.schema["host"].dataType), *StructType.fromDDL(lists).fields])
    distinct = rows.mapInArrow(tokens, schema).dropDuplicates(["host", "key"])
    token = distinct.select("host", "key", F.inline(F.arrays_zip("token", "parent", "depth", "n", "is_text")))
    cell = F.xxhash64("key", "n")  # of the occurrence vector; its sum over the pages stands for the vector
    sums = token.groupBy("host", "token", "parent", "depth", "is_text").agg(
        F.sum(cell.bitwiseAND(F.lit(0x7FFFFFFF))).alias("v1"), F.sum(F.shiftrightunsigned(cell, 32).bitwiseAND(F.lit(0x7FFFFFFF))).alias("v2"), F.count(F.lit(1)).alias("pages"),
    )
    sums = cut_lineage(sums.where(F.col("pages") >= LEAST_PAGES))
    whole = sums.where("depth = 0").select("host", F.col("pages").alias("all_pages"))
    few = whole.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return sums.join(F.broadcast(whole) if few else whole, "host").where(F.col("pages") >= MOST_PAGES * F.col("all_pages")).drop("all_pages")


def standing(tokens: list[dict]) -> list[int]:
    """The texts among the frequent tokens of a host that have the vector of an element around them."""
    vector = {t["token"]: (t["v1"], t["v2"]) for t in tokens if not t["is_text"]}
    children, texts = defaultdict(list), defaultdict(list)
    for t in tokens:
        if t["is_text"]:
            texts[t["parent"]].append((t["token"], (t["v1"], t["v2"])))
        elif t["depth"]:
            children[t["parent"]].append(t["token"])
    around, found, todo = Counter(), [], [(0, 1)]  # vectors of the elements on the path to the present one
    while todo:
        role, step = todo.pop()
        around[vector[role]] += step
        if step > 0:
            found += [token for token, v in texts[role] if around[v]]
            todo.append((role, -1))
            todo += [(child, 1) for child in children[role]]
    return found


def template_texts(template: DataFrame) -> DataFrame:
    """(host, texts): the text tokens of each host's template, for hosts that have any. A host's frequent tokens are at most twice those of its average page."""
    of_host = template.groupBy("host").agg(F.collect_list(F.struct("is_text", "token", "parent", "depth", "v1", "v2")).alias("tokens"), F.max("is_text").alias("some")).where("some").select("host", "tokens")

    def nest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if found := standing(batch.column("tokens")[i].as_py()):
                    yield pa.RecordBatch.from_arrays([batch.column("host").slice(i, 1), list_array(np.array(found, np.int64), np.array([len(found)]))], names=["host", "texts"])

    return of_host.mapInArrow(nest, StructType([of_host.schema["host"], *StructType.fromDDL("texts array<bigint>").fields]))


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    known = cut_lineage(template_texts(templates(pages)))
    few = (known.agg(F.sum(F.size("texts") + 1)).first()[0] or 0) <= BROADCAST_ROWS
    rows = pages.select("page_id", "url", _host("url").alias("host"), text_of(F.col("html")).alias("html")).join(F.broadcast(known) if few else known, "host", "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [Page(h).text(t) for h, t in zip(part.column("html").to_pylist(), part.column("texts").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    schema = StructType([rows.schema["page_id"], rows.schema["url"], *StructType.fromDDL("text string, n_chars bigint").fields])
    return rows.select("page_id", "url", "html", "texts").mapInArrow(extract, schema)
