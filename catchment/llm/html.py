"""Main-text extraction by wrapper induction.

A page's DOM becomes a skeleton: block elements with their class and id, inline ones left out, runs
of equal siblings folded into one node. A host's reference is its most frequent skeleton. Every
skeleton of the host is aligned with it by simple tree matching, which gives each node its slot.
Over all distinct pages of the host (mirrors counted once) a slot is constant, where its text never
changes, and so template, or varying, and so a candidate for content; slots of a single page are, too. Slots in menus, adverts, footers, forms, notices and
comments are never content. Where a host has a main element (article, main), content lies in its
slots. Of these, a slot is template where its text is the same on pages of different articles; pages
whose articles are near copies (least hashes of word triples) count as one, as they repeat content.

All steps are joins and aggregates over hosts: no host's pages come together in a task.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchment.llm.common import map_batches, stored

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>"
    r"|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "object", "canvas", "math"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "label", "img", "br", "wbr"}
#: A start tag on the left ends an open element on the right.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"article", "aside", "body", "div", "footer", "form", "header", "main", "nav", "ol", "section", "table", "td", "th", "ul"}

_NEVER = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", *_RAW}
_NEVER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar"}
_NEVER_WORDS = set("ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice notices newsletter subscribe popup modal sidebar widget related breadcrumb breadcrumbs menu nav navbar navigation share social comment comments respond disqus footer masthead".split())
#: Levels of a skeleton. Elements below keep their own flags, but lie in the slot of what encloses them.
_DEPTH = 200


#: Odd multipliers of word-triple hashes; each gives one least hash that near copies mostly share.
_MIXERS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53]


class Node:
    __slots__ = ("tag", "label", "never", "main", "children", "number", "anchor")

    def __init__(self, tag: str, label: str, never: bool, main: bool):
        self.tag, self.label, self.never, self.main, self.children, self.number, self.anchor = tag, label, never, main, [], 0, self

    @property
    def place(self) -> int:
        """The place in the skeleton of the element, or of the one around it that the skeleton has."""
        return self.anchor.number


def _node(tag: str, attributes: str, parent: Node) -> Node:
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    main = parent.main or tag in ("article", "main") or found.get("role") == "main"
    never = (
        parent.never
        or tag in _NEVER
        or (tag == "header" and not parent.main)
        or found.get("role") in _NEVER_ROLES
        or (tag not in ("html", "body", "article", "main") and not _NEVER_WORDS.isdisjoint(re.split(r"[^a-z0-9]+", names)))
    )
    label = tag + "".join("." + x for x in sorted(names.split()))
    return Node(tag, label, never, main and not never)


def parse(html: str) -> tuple[Node, list[tuple[Node, str]]]:
    """Root of the block elements and the text blocks in page order, each with its element.

    White space inside a block is one space; character references are decoded; empty blocks go.
    Unclosed elements end with what encloses them; elements nested over ``_DEPTH`` deep are no nodes
    of the tree. An unclosed comment or script lasts to the end.
    """
    root = Node("#", "#", False, False)
    stack, blocks, parts, at = [root], [], [], 0
    opened: dict[str, int] = {}

    def flush():
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                blocks.append((stack[-1], text))
            parts.clear()

    def pop_to(k: int):
        flush()
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    while found := _TAG.search(html, at):
        if found.start() > at:
            parts.append(html[at : found.start()])
        at = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), found[1] or found[4], found[3] or found[6] or ""
        if tag in _RAW and not closing and not attributes.endswith("/"):
            end = re.compile(f"</{tag}[^<>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            if tag != "title":
                parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in _INLINE:
            continue
        if closing:
            if not opened.get(tag):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    pop_to(k)
                    break
                if stack[k].tag in _SCOPE and tag not in _SCOPE:
                    break
            continue
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p" or stack[k].tag in _ENDS.get(tag, ()):
                pop_to(k)
                break
            if stack[k].tag in _SCOPE:
                break
        flush()
        if tag in _VOID or attributes.endswith("/"):
            continue
        node = _node(tag, attributes, stack[-1])
        if len(stack) < _DEPTH:
            stack[-1].children.append(node)
        else:
            node.anchor = stack[-1].anchor
        opened[tag] = opened.get(tag, 0) + 1
        stack.append(node)
    parts.append(html[at:])
    flush()
    return root, blocks


def skeleton(root: Node) -> str:
    """The page's tree as JSON lists [label, flags, children...]; numbers its nodes' places in it.

    Consecutive equal siblings share a place. Flags: 1 never content, 2 inside the main element.
    """
    shape: dict[int, str] = {}
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.children
    for node in reversed(order):
        inner, last = [], None
        for child in node.children:
            if shape[id(child)] != last:
                inner.append(last := shape[id(child)])
        shape[id(node)] = "[" + ",".join([json.dumps(node.label), str(node.never + 2 * node.main), *inner]) + "]"
    count = 0
    todo = [(root, None)]
    while todo:  # preorder, with equal neighbours at one place
        node, same = todo.pop()
        if same is None:
            node.number, count = count, count + 1
            first = None
        else:
            node.number = same.number
        last, before, below = None, None, []
        twins = iter(_folded(same.children, shape)) if same is not None else None
        for child in node.children:
            if shape[id(child)] != last:
                last, before = shape[id(child)], child
                below.append((child, next(twins) if twins else None))
            else:
                below.append((child, before))
        todo += reversed(below)
    return shape[id(root)]


def _folded(children: list[Node], shape: dict[int, str]) -> list[Node]:
    return [c for k, c in enumerate(children) if not k or shape[id(c)] != shape[id(children[k - 1])]]


class Tree:
    """A skeleton read again, its nodes in preorder."""

    def __init__(self, text: str):
        self.labels, self.flags, self.children = [], [], []
        todo = [(json.loads(text), None)]
        while todo:
            node, parent = todo.pop()
            place = len(self.labels)
            self.labels.append(node[0])
            self.flags.append(node[1])
            self.children.append([])
            if parent is not None:
                self.children[parent].append(place)
            todo += [(x, place) for x in reversed(node[2:])]


def match(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: places of ``a`` to places of ``b``, the most nodes in order, parents first."""
    scores: dict[tuple[int, int], int] = {}
    ways: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def score(x: int, y: int) -> int:
        if a.labels[x] != b.labels[y]:
            return 0
        if (x, y) in scores:
            return scores[x, y]
        left, right = a.children[x], b.children[y]
        table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for i, p in enumerate(left, 1):
            for j, q in enumerate(right, 1):
                table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + score(p, q))
        pairs, i, j = [], len(left), len(right)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((left[i], right[j]))
        ways[x, y] = pairs
        scores[x, y] = 1 + table[-1][-1]
        return scores[x, y]

    out = {}
    if score(0, 0):
        todo = [(0, 0)]
        while todo:
            x, y = todo.pop()
            out[x] = y
            todo += ways[x, y]
    return out


def least_hashes(text: str) -> list[int]:
    """A least hash of the word triples of ``text`` for each of ``_MIXERS``."""
    words = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in text.split()] + [0, 0], np.uint64)
    if len(words) == 2:
        return [0] * len(_MIXERS)
    words = words[:-2] * np.uint64(_MIXERS[0]) + words[1:-1] * np.uint64(_MIXERS[1]) + words[2:] * np.uint64(_MIXERS[2])
    words ^= words >> np.uint64(29)
    out = []
    for m in _MIXERS:
        mixed = words * np.uint64(m)
        out.append(int((mixed ^ (mixed >> np.uint64(32))).min() >> np.uint64(1)))
    return out


@lru_cache(4096)
def slots(page: str, reference: str) -> tuple[int, ...]:
    """Slot of each place of a skeleton: its place in the reference, or -1."""
    tree = Tree(page)
    found = {k: k for k in range(len(tree.labels))} if page == reference else match(tree, Tree(reference))
    return tuple(found.get(k, -1) for k in range(len(tree.labels)))


@lru_cache(4096)
def _flags(page: str) -> tuple[int, ...]:
    return tuple(Tree(page).flags)


def _host_column():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _slot_texts(pages: DataFrame) -> DataFrame:
    """host, skeleton, the text hash of each place, that of all that may be content, and ``near``, for each page.

    ``near`` has the least hashes of the main element's text, and is empty where there is none.
    """
    names = ["host", "skeleton", "hashes", "content", "near"]

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            skeletons, hashes, contents, near = [], [], [], []
            for text in batch.column(1).to_pylist():
                root, blocks = parse(text or "")
                skeletons.append(skeleton(root))
                digests: dict[int, xxhash.xxh64] = {}
                whole = xxhash.xxh64()
                for node, block in blocks:
                    if not node.never:
                        whole.update(block + "\n")
                    digests.setdefault(node.place, xxhash.xxh64()).update(block + "\n")
                own = [0] * len(_flags(skeletons[-1]))
                for place, digest in digests.items():
                    own[place] = digest.intdigest() >> 1
                hashes.append(own)
                contents.append(whole.intdigest() >> 1)
                inside = " ".join(block for node, block in blocks if node.main)
                near.append(least_hashes(inside) if inside else [])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(skeletons, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(contents, pa.int64()), pa.array(near, pa.list_(pa.int64()))], names)

        return work

    return map_batches(pages.select("host", "html"), make, "host string, skeleton string, hashes array<long>, content long, near array<long>")


def _articles(pages: DataFrame) -> DataFrame:
    """host, content of one page of each group of near copies among ``pages`` (host, content, near).

    A round for each least hash keeps one page of those that share it. Different articles whose least
    triple is in the host's template go together, too, which only makes fewer articles.
    """
    left = pages.where(F.size("near") > 0).select("host", "content", "near")
    for k in range(len(_MIXERS)):
        left = left.groupBy("host", F.col("near")[k].alias("_k")).agg(F.min(F.struct("content", "near")).alias("page")).select("host", "page.*")
    return left.select("host", "content", F.lit(True).alias("article"))


def wrappers(pages: DataFrame) -> DataFrame:
    """host, reference (skeleton), content (places of the reference that hold content); a row per host.

    ``pages`` has host and html. Pages of a host that differ at most in what is never content count as
    one; ties between skeletons go to the lesser string.
    """
    pages = _slot_texts(pages).groupBy("host", "content").agg(F.min(F.struct("skeleton", "hashes", "near")).alias("page")).select("host", "content", "page.*")
    pages = stored(pages, "pages")
    pages = pages.join(_articles(pages), ["host", "content"], "left")
    # Inside a host, pages of one skeleton come down to the least and greatest text hash of each place,
    # over all pages and over those of different articles.
    texts = pages.select("host", "skeleton", "article", F.posexplode("hashes").alias("place", "hash"))
    own = F.when(F.col("article"), F.col("hash"))
    spread = texts.groupBy("host", "skeleton", "place").agg(F.count("*").alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"), F.count(own).alias("articles"), F.min(own).alias("least"), F.max(own).alias("most"))
    shapes = spread.groupBy("host", "skeleton").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "low", "high", "articles", "least", "most"))).alias("spread"))
    shapes = stored(shapes, "skeletons")
    reference = shapes.groupBy("host").agg(F.max_by("skeleton", F.struct(F.col("n"), F.col("skeleton"))).alias("reference"))
    aligned = shapes.join(reference, "host")

    def make():
        kept = ["low", "high", "articles", "least", "most"]
        names = ["host", "reference", "slot", *kept, "n"]

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for host, page, reference, n, spread in zip(*(c.to_pylist() for c in batch.columns)):
                for place, slot in enumerate(slots(page, reference)):
                    if slot >= 0:
                        rows.append((host, reference, slot, *(spread[place][x] for x in kept), n))
            kinds = [pa.string(), pa.string(), *[pa.int64()] * 7]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        return work

    narrow = aligned.select("host", "skeleton", "reference", "n", F.col("spread"))
    found = map_batches(narrow, make, "host string, reference string, slot long, low long, high long, articles long, least long, most long, n long")
    found = found.groupBy("host", "reference", "slot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("articles").alias("articles"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n"))
    varying = (F.col("low") < F.col("high")) | (F.col("n") == 1)
    # In a main element, text that different articles share is template; near copies are one article.
    shared = (F.col("articles") > 1) & (F.col("least") == F.col("most")) & (F.col("low") == F.col("high"))
    per_host = found.groupBy("host", "reference").agg(F.collect_set(F.when(varying, F.col("slot"))).alias("varying"), F.collect_set(F.when(shared, F.col("slot"))).alias("shared"))

    def decide():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            content = []
            for reference, varying, shared in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                flags = _flags(reference)
                inside = [k for k, f in enumerate(flags) if f & 2]
                content.append(sorted(set(inside) - set(shared)) if inside else sorted(k for k in varying if not flags[k] & 1))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(content, pa.list_(pa.int64()))], ["host", "reference", "content"])

        return work

    return map_batches(per_host, decide, "host string, reference string, content array<long>")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Null and empty html give "" and 0. Pages without a host (null or odd urls) share the host "".
    Repeated rows are kept; other columns are ignored. A page's nodes that match no slot of the
    wrapper are content where they lie in a main element, or where the page has none.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", _host_column())
    known = stored(wrappers(rows), "wrappers")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = []
            for page, reference, content in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                root, blocks = parse(page or "")
                own = skeleton(root)
                flags, chosen = _flags(own), set(content or ())
                has_main = any(f & 2 for f in flags)
                slot = slots(own, reference) if reference else (-1,) * len(flags)
                keep = [s in chosen if s >= 0 and (flags[k] & 2 or not has_main) else bool(flags[k] & 2) or not (has_main or flags[k] & 1) for k, s in enumerate(slot)]
                texts.append("\n".join(text for node, text in blocks if (keep[node.place] or node.main > node.anchor.main) and not node.never))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

        return work

    joined = rows.join(known, "host", "left").select("page_id", "url", "html", "reference", "content")
    return map_batches(joined, make, "page_id long, url string, text string, n_chars long")
