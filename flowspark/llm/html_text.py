"""Main text of web pages by wrapper induction.

The pages of a host share a wrapper. One page of each host, of ordinary length, stands for
it; every page's tree is aligned with that page's tree by simple tree matching. A text node
that nearly all pages of the host fill with the same text belongs to the template; slots
whose text varies hold content. Copies of one page count as one page. Counts of (host, slot, text) over all pages decide, so that
a host with many pages is summed like any other and never gathered.

Template text is left out of the content. Boilerplate that varies from page to page (menus,
adverts, notices, comments and the like) is known by its element, role, class or id. Where a
page marks its article or main part, only that part counts.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, table
from .dom import BLOCK, Node, Shapes, clean, parse
from .url_filter import url_host

#: Length of the page that stands for its host, about.
ORDINARY = 4096
#: A slot is template when this share of the host's different pages has the same text in it, if the
#: host shows at least so many different texts in some other slot.
SHARE, LEAST_PAGES = 0.9, 5

DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form head iframe input map menu nav noscript object output"
    " script search select style svg template textarea title video".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id that name a part which is no article text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies"
    " disqus feedback footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain"
    " pager pagination paywall popup promo promoted promotion recommended related reply replies respond responses share sharing"
    " sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar topbar widget".split()
)
MARK = re.compile(r"[a-z]+|[A-Z][a-z]*")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


def _is_boilerplate(node: Node, in_article: bool) -> bool:
    if node.tag in DROPPED or (node.tag == "header" and not in_article):
        return True
    if not node.attributes.strip(" /") or node.tag in ("html", "body", "article", "main") and "comment" not in node.attributes.lower():
        return False
    named = node.named()
    if "hidden" in named or named.get("aria-hidden", "").lower() == "true" or HIDDEN.search(named.get("style", "")):
        return True
    if set(named.get("role", "").lower().split()) & ROLES:
        return True
    words = {w.lower() for w in MARK.findall(f"{named.get('class', '')} {named.get('id', '')}")}
    return bool(words & MARKS) or (not in_article and "header" in words)


def _roots(tree: Node) -> list[tuple[Node, bool]]:
    """The outermost articles; else the main parts; else the whole page."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [tree]
    while todo:
        node = todo.pop()
        kind = node.tag if node.tag in found else None
        if node.attributes and kind is None:
            role = node.named().get("role", "").lower() if "role" in node.attributes.lower() else ""
            kind = role if role in found else None
        if node is not tree and _is_boilerplate(node, kind is not None):
            continue
        if kind:
            found[kind].append(node)
        if kind != "article":
            todo += reversed(node.children)
    for kind in ("article", "main"):
        if found[kind]:
            return [(n, True) for n in found[kind]]
    return [(tree, False)]


def main_text(tree: Node, template: set[int]) -> str:
    """Blocks of the content; template holds the identities of template text nodes.

    A block goes when all its text is template; fixed words within a varying block stay.
    """
    blocks: list[str] = []
    run: list[str] = []
    varying: list[bool] = []

    def end() -> None:
        if any(varying) and (text := clean("".join(run))):
            blocks.append(text)
        run.clear()
        varying.clear()

    for root, inside in _roots(tree):
        todo: list[tuple[Node, bool]] = [(root, False)]
        while todo:
            node, done = todo.pop()
            if node.tag == "#text":
                run.append(node.text)
                varying.append(id(node) not in template)
            elif node.tag in ("#blank", "br", "wbr"):
                run.append("" if node.tag == "wbr" else " ")
            elif done:
                end()
            elif node is root or not _is_boilerplate(node, inside):
                if node.tag in BLOCK or node is root:
                    end()
                    todo.append((node, True))
                todo += [(c, False) for c in reversed(node.children)]
            elif node.tag in BLOCK:
                end()
        end()
    return "\n\n".join(blocks)


def skeleton(tree: Node) -> str:
    """A tree's elements and text places without the texts."""

    def plain(n: Node) -> list:
        return [n.tag, [plain(c) for c in n.children if c.tag != "#blank"]]

    return json.dumps(plain(tree), separators=(",", ":"))


def from_skeleton(text: str) -> tuple[Node, dict[int, int]]:
    """The tree, and its text places numbered in page order, by identity."""
    places: dict[int, int] = {}

    def build(part: list) -> Node:
        node = Node(part[0])
        if node.tag == "#text":
            places[id(node)] = len(places)
        node.children = [build(c) for c in part[1]]
        return node

    return build(json.loads(text)), places


class Wrappers:
    """The skeletons of the hosts a task meets, parsed once each, up to a number of hosts."""

    LIMIT = 2000

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        self.shapes, self.known = Shapes(), {}

    def slots(self, tree: Node, host: str, wrapper: str) -> list[tuple[Node, int]]:
        """The page's text nodes that align with a text place of the host's wrapper, and which."""
        if len(self.known) >= self.LIMIT or len(self.shapes.parts) >= Shapes.LIMIT:
            self._clear()
        if host not in self.known:
            model, places = from_skeleton(wrapper)
            self.shapes.label(model)
            self.known[host] = model, places
        model, places = self.known[host]
        self.shapes.label(tree)
        return [(a, places[id(b)]) for a, b in self.shapes.align(tree, model) if a.tag == "#text"]


def _signature(text: str) -> int:
    return xxhash.xxh64_intdigest(clean(text).encode("utf-8", "surrogatepass")) - (1 << 63)


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): the skeleton of the page whose length is nearest to ORDINARY."""
    own = F.xxhash64("html").alias("own")
    sized = pages.where("html <> ''").select("host", F.abs(F.length("html") - ORDINARY).alias("off"), own)
    picked = sized.groupBy("host").agg(F.min(F.struct("off", "own"))["own"].alias("own"))
    found = pages.withColumn("own", F.xxhash64("html")).join(picked, ["host", "own"]).groupBy("host").agg(F.min("html").alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"host": batch["host"], "wrapper": [skeleton(parse(h)) for h in batch["html"]]})

    return keep(found.mapInPandas(run, "host string, wrapper string"))


def template_texts(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, template): the slots of each host's wrapper that are template, with their text's signature."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = Wrappers(), Counter()
        for batch in batches:
            for host, page, wrapper, copies in zip(batch["host"], batch["html"], batch["wrapper"], batch["copies"], strict=True):
                for node, slot in known.slots(parse(page), host, wrapper):
                    counts[host, slot, _signature(node.text)] += 1 / copies
            if len(counts) > 100_000:
                yield _counted(counts)
                counts = Counter()
        if counts:
            yield _counted(counts)

    filled = pages.where("html <> ''").withColumn("_one", F.xxhash64("html")).withColumn("_two", F.xxhash64(F.lit(1), "html"))
    different = keep(filled.groupBy("host", "_one", "_two").agg(F.count("*").alias("copies")))
    repeated = keep(different.where("copies > 1"))
    seen = filled.join(repeated, ["host", "_one", "_two"], "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    seen = seen.join(wrappers, "host").select("host", "html", "wrapper", "copies")
    texts = seen.mapInPandas(run, "host string, slot int, text long, n double")
    texts = keep(texts.groupBy("host", "slot", "text").agg(F.sum("n").alias("n")))
    # For each slot its most frequent text and how many there are; for each host its pages.
    slots = texts.groupBy("host", "slot").agg(F.max(F.struct("n", "text")).alias("top"), F.count("*").alias("kinds"))
    sizes = different.groupBy("host").agg(F.count("*").alias("pages"))
    variety = slots.groupBy("host").agg(F.max("kinds").alias("variety"))
    constant = slots.join(sizes, "host").join(variety, "host")
    constant = constant.where((F.col("top.n") >= SHARE * F.col("pages") - 1e-6) & (F.col("variety") >= LEAST_PAGES))
    return keep(constant.groupBy("host").agg(F.collect_list(F.struct("slot", F.col("top.text").alias("text"))).alias("template")))


def _counted(counts: Counter) -> pd.DataFrame:
    host, slot, text = zip(*counts, strict=True)
    return pd.DataFrame({"host": host, "slot": slot, "text": text, "n": list(counts.values())})


def extract_text(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) to (page_id, url, text).

    Null and empty html give an empty text. Null urls and urls without a host form one host
    of their own. Repeated pages give the same text each; other columns are not used.
    """
    pages = pages.select("page_id", "url", "html").withColumn("host", url_host(F.col("url")))
    wrappers = host_wrappers(pages)
    templates = template_texts(pages, wrappers)
    models = keep(wrappers.join(templates, "host"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Wrappers()
        for batch in batches:
            texts = []
            for host, page, wrapper, template in zip(batch["host"], batch["html"], batch["wrapper"], batch["template"], strict=True):
                tree, constant = parse(page if isinstance(page, str) else ""), set()
                if template is not None and len(template):
                    fixed = {(t["slot"], t["text"]) for t in template}
                    constant = {id(n) for n, slot in known.slots(tree, host, wrapper) if (slot, _signature(n.text)) in fixed}
                texts.append(main_text(tree, constant))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts})

    kinds = ", ".join(f"{c} {dict(pages.dtypes)[c]}" for c in ("page_id", "url"))
    return pages.join(models, "host", "left").select("page_id", "url", "html", "host", "wrapper", "template").mapInPandas(run, f"{kinds}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract_text(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
