"""Main text of web pages by wrapper induction.

Pages of a host are read into small trees of containers (``dom``).  The distinct trees of a host are merged into its
wrapper by simple tree matching, in groups and rounds, so that no task holds a host.  What is known of a tree's
containers is collected in the tasks that read the pages and added up in Spark: on how many pages a container has text, how
much of it lies in links, and which blocks were the same on all these pages.  Such a block is template if these pages
differ elsewhere (their longest blocks are not all equal), else content: a container's varying slot, or a copy of a page.  Then every page is read
again beside its host's wrapper: template blocks go, as do containers that mostly hold links; of the rest the page's main
region is taken, its articles where most of the host's varying text lies in such, else the deepest container with 70 % of it.

Only trees and hashes of blocks are shuffled.  All wrappers are sent to every task if they are measured to be small
(``BROADCAST_BYTES``); else pages and wrappers are joined by host, and hot hosts split (AQE).

Defined cases: null html is an empty text; pages without a host in their url form a host together; repeated rows each give a row; columns
other than page_id, url and html are ignored; an empty table gives no rows.  A host with one page has no template, only the
elements that say what they are go.  Bounds: elements more than 48 deep count as text of the container there.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import dom

#: Trees that one task merges at a time.
FAN_IN = 64
#: Trees for which a task keeps sums before it hands them on.
FLUSH = 20000
#: Wrappers of all hosts that may go to every task; more are joined by host.
BROADCAST_BYTES = 8 << 20
#: Share of a page's varying text that makes a container the main region; of articles; share of links that makes a menu.
DESCEND, ARTICLES, LINKED = 0.7, 0.5, 0.5
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
STATS = ("host string, tree_id long, tree string, slots array<struct<node:int,pages:long,chars:long,links:long,"
         "same:array<struct<h:long,size:long,pages:long,low:long,high:long>>>>")


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _collect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per host and tree: the tree and its containers' sums over the task's pages.  Of the blocks of a container only those
    stay that all pages so far have."""
    seen: dict[tuple[str, int], tuple[str, dict[int, list]]] = {}
    dumped: dict[str, tuple[int, str]] = {}

    def rows() -> pd.DataFrame:
        out = [(host, tid, tree, [(node, p, c, k, [(h, *v) for h, v in same.items()]) for node, (p, c, k, same) in slots.items()])
               for (host, tid), (tree, slots) in seen.items()]
        seen.clear()
        dumped.clear()
        return pd.DataFrame(out, columns=["host", "tree_id", "tree", "slots"])

    for frame in frames:
        for host, source in zip(frame["host"], frame["html"], strict=True):
            if not source:
                continue
            page = dom.read(source)
            if page.tree.shape not in dumped:
                text = dom.dump(page.tree)
                dumped[page.tree.shape] = _hash(text), text
            tid, tree = dumped[page.tree.shape]
            slots = seen.setdefault((host, tid), (tree, {}))[1]
            longest = _hash(max((b[0] for b in page.blocks), key=lambda t: (len(t), t), default=""))
            mine: dict[int, list] = {}
            for text, links, node in page.blocks:
                slot = mine.setdefault(node, [0, 0, {}])
                slot[0] += len(text)
                slot[1] += links
                slot[2].setdefault(_hash(text), len(text))
            for node, (chars, links, blocks) in mine.items():
                slot = slots.get(node)
                if slot is None:
                    slots[node] = [1, chars, links, {h: [n, 1, longest, longest] for h, n in blocks.items()}]
                    continue
                slot[0] += 1
                slot[1] += chars
                slot[2] += links
                same = slot[3]
                for h in [h for h in same if h not in blocks]:
                    del same[h]
                for v in same.values():
                    v[1] += 1
                    v[2], v[3] = min(v[2], longest), max(v[3], longest)
            if len(seen) >= FLUSH:
                yield rows()
    yield rows()


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    """One tree for a group of a host's trees, merged in the order of their ids."""
    group = group.sort_values(["tree_id", "tree"])
    trees = [dom.load(t) for t in dict.fromkeys(group["tree"])]
    for other in trees[1:]:
        dom.merge(trees[0], other)
    text = dom.dump(trees[0])
    return pd.DataFrame({"host": [group["host"].iloc[0]], "tree_id": [_hash(text)], "tree": [text]})


def wrappers(trees: DataFrame) -> DataFrame:
    """(host, wrapper) from distinct (host, tree_id, tree)."""
    schema = "host string, tree_id long, tree string"
    while True:
        most = trees.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= 1:
            return trees.select("host", F.col("tree").alias("wrapper"))
        salt = F.pmod(F.xxhash64("tree_id"), F.lit(math.ceil(most / FAN_IN))).alias("salt")
        trees = cut_lineage(trees.groupBy("host", salt).applyInPandas(_merge, schema))


def _map(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    loaded: dict[str, dom.Node] = {}
    for frame in frames:
        places = []
        for tree, wrapper in zip(frame["tree"], frame["wrapper"], strict=True):
            if wrapper not in loaded:
                loaded.clear()
                loaded[wrapper] = dom.load(wrapper)
            places.append(dom.align(dom.load(tree), loaded[wrapper]))
        yield frame[["host", "tree_id"]].assign(places=places)


def induce(pages: DataFrame) -> DataFrame:
    """(host, wrapper, slots) for pages with host and html: the wrapper tree and its containers' pages, varying code
    points, code points in links, and template blocks."""
    stats = cut_lineage(pages.select("host", "html").mapInPandas(_collect, STATS))
    trees = cut_lineage(stats.groupBy("host", "tree_id").agg(F.first("tree").alias("tree")))
    wrapper = cut_lineage(wrappers(trees))
    places = trees.join(wrapper, "host").sortWithinPartitions("host").mapInPandas(
        _map, "host string, tree_id long, places array<int>")
    slots = stats.select("host", "tree_id", F.explode("slots").alias("s")).join(places, ["host", "tree_id"]).select(
        "host", F.element_at("places", F.col("s.node") + 1).alias("node"), "s.pages", "s.chars", "s.links", "s.same").where("node >= 0")
    slots = cut_lineage(slots)
    of_node = slots.groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in ("pages", "chars", "links")])
    block = slots.select("host", "node", F.explode("same").alias("b")).groupBy("host", "node", F.col("b.h").alias("h")).agg(
        F.sum("b.pages").alias("on"), F.max("b.size").alias("size"), F.min("b.low").alias("low"), F.max("b.high").alias("high"))
    template = block.where("low <> high").join(of_node.select("host", "node", F.col("pages").alias("on")), ["host", "node", "on"]).groupBy(
        "host", "node").agg(F.collect_list("h").alias("template"), F.sum(F.col("size") * F.col("on")).alias("fixed"))
    known = of_node.join(template, ["host", "node"], "left").select(
        "host", F.struct("node", "pages", F.greatest(F.col("chars") - F.coalesce("fixed", F.lit(0)), F.lit(0)).alias("chars"),
                         (F.col("links") > F.lit(LINKED) * F.col("chars")).alias("menu"), "template").alias("s"))
    return wrapper.join(known.groupBy("host").agg(F.to_json(F.collect_list("s")).alias("slots")), "host", "left")


class Wrapper:
    """A host's wrapper, ready for use in a task."""

    def __init__(self, wrapper: str | None, slots: str | None) -> None:
        self.tree = dom.load(wrapper) if wrapper else None
        self.weight: dict[int, float] = {}
        self.menu: set[int] = set()
        self.template: dict[int, set[int]] = {}
        for s in json.loads(slots) if slots else ():
            self.weight[s["node"]] = s["chars"] / s["pages"]
            self.template[s["node"]] = set(s.get("template") or ())
            if s["menu"]:
                self.menu.add(s["node"])
        self._plans: dict[str, tuple[list[int], set[int], set[int]]] = {}

    def plan(self, page: dom.Page) -> tuple[list[int], set[int], set[int]]:
        """For the trees of a page: partners in the wrapper, containers of the main region, containers in articles."""
        key = f"{page.mains}{page.tree.shape}"
        if key not in self._plans:
            if len(self._plans) > 4096:
                self._plans.clear()
            self._plans[key] = self._plan(page)
        return self._plans[key]

    def _plan(self, page: dom.Page) -> tuple[list[int], set[int], set[int]]:
        nodes = dom.preorder(page.tree)
        number = {id(x): i for i, x in enumerate(nodes)}
        place = dom.align(page.tree, self.tree) if self.tree else [-1] * len(nodes)
        last = list(range(len(nodes)))  # last of a subtree in preorder
        for i in range(len(nodes) - 1, -1, -1):
            if nodes[i].kids:
                last[i] = last[number[id(nodes[i].kids[-1])]]
        main: set[int] = set()
        for m in page.mains:
            main.update(range(m, last[m] + 1))
        weight = [self.weight.get(p, 0.0) if i in main or p not in self.menu else 0.0 for i, p in enumerate(place)]
        total = sum(weight)
        if total <= 0:
            return place, main or set(range(len(nodes))), main
        region = set(range(len(nodes)))
        if sum(weight[i] for i in main) >= ARTICLES * total:
            # the innermost articles that hold most of the text of the outer ones
            tops = [m for m in page.mains if not any(o < m <= last[o] for o in page.mains)]
            region = set()
            for m in tops:
                inner = {i for o in page.mains if m < o <= last[m] for i in range(o, last[o] + 1)}
                own = range(m, last[m] + 1)
                region |= inner if sum(weight[i] for i in inner) >= DESCEND * sum(weight[i] for i in own) > 0 else set(own)
            return place, region, main
        at = 0
        while True:
            whole = sum(weight[at:last[at] + 1])
            best = max((number[id(k)] for k in nodes[at].kids), key=lambda k: sum(weight[k:last[k] + 1]), default=None)
            if best is None or sum(weight[best:last[best] + 1]) < DESCEND * whole:
                return place, set(range(at, last[at] + 1)), main
            at = best

    def text(self, source: str) -> str:
        page = dom.read(source)
        place, region, main = self.plan(page)
        kept = []
        for text, _, node in page.blocks:
            p = place[node]
            if node in region and (node in main or p not in self.menu) and not (
                    self.template.get(p) and _hash(text) in self.template[p]):
                kept.append(text)
        return " ".join(kept)


def _extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[tuple[str, str], Wrapper] = {}
    for frame in frames:
        texts = []
        for source, wrapper, slots in zip(frame["html"], frame["wrapper"], frame["slots"], strict=True):
            key = (wrapper, slots)
            if key not in known:
                if len(known) >= 256:
                    known.clear()
                known[key] = Wrapper(wrapper, slots)
            texts.append(known[key].text(source) if source else "")
        yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts,
                            "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page; see the module."""
    id_type = pages.schema["page_id"].dataType
    hosted = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html",
                          F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"))
    found = cut_lineage(induce(hosted))
    size = found.agg(F.sum(F.octet_length("wrapper") + F.coalesce(F.octet_length("slots"), F.lit(0)))).first()[0] or 0
    known = F.broadcast(found) if size <= BROADCAST_BYTES else found
    out = hosted.join(known, "host", "left").select("page_id", "url", "html", "wrapper", "slots").mapInPandas(
        _extract, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast(id_type))


def op13_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
