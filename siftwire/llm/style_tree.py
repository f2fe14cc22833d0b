"""Main text of pages by site style trees: pages of a host merged into one tree, whose dull branches go.

An element of the tree is a place: the host, and on the way down each style (the sequence of child
elements, runs of equal ones with their length) and the place in it. Names of places are hashes, so
every page finds its own without the tree, and merging is an aggregate. An element that shows many
styles, and a leaf whose contents differ from page to page, is important; the entropies over the
host's pages say how much. Every page asks the tree. Roles that pages give to elements (menus, forms,
the article) say what a branch is: where elements are named as the article, each stays or goes as a whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwire.llm.common import stored
from siftwire.llm.dom import Page, parse

#: Weight that an element's own presentation leaves to what is below it, for each of its styles.
GAMMA = 0.9
#: Branches below it are noise.
THRESHOLD = 0.3
#: An element on fewer pages of its host says nothing yet and counts as important.
MIN_PAGES = 3
_STYLE, _FEATURE, _LEAF = 0, 1, 2
#: Facts that a task combines before it hands them on.
_HELD = 1 << 17


def _hash(*parts) -> int:
    joined = "\x1f".join(map(str, parts)) if len(parts) > 1 else str(parts[0])
    return xxhash.xxh64_intdigest(joined.encode("utf-8", "replace")) - (1 << 63)


def site_of(url: str | Column) -> Column:
    """The host of an address with A-Z in lower case; without ``://`` the empty host."""
    address = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    host = F.regexp_extract(address, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def places(page: Page, site: str) -> tuple[list[int], list[int]]:
    """(element, style) of every node: names that equal places of a host's pages share."""
    element, style = [0] * len(page.nodes), [0] * len(page.nodes)
    element[0] = _hash(site)
    for i, node in enumerate(page.nodes):
        if not node.children:
            style[i] = _hash(element[i])
            continue
        runs: list[list] = []
        for child in node.children:
            name = page.nodes[child].name
            if runs and runs[-1][0] == name:
                runs[-1][1].append(child)
            else:
                runs.append([name, [child]])
        style[i] = _hash(element[i], *(f"{name}*{len(own)}" for name, own in runs))
        for n, (name, own) in enumerate(runs):
            for child in own:
                element[child] = _hash(style[i], n, name)
    return element, style


def facts(page: Page, site: str) -> Counter:
    """How often a page shows (element, _STYLE, style), (leaf style, _FEATURE, content) and (leaf style, _LEAF, 0)."""
    element, style = places(page, site)
    shown: dict[int, list] = {}
    for i, text in page.blocks:
        shown.setdefault(i, []).append(text)
    out: Counter = Counter()
    for i, node in enumerate(page.nodes):
        out[element[i], _STYLE, style[i]] = 1
        if not node.children:
            out[style[i], _LEAF, 0] = 1
            for content in (*shown.get(i, ()), *node.marks):
                out[style[i], _FEATURE, _hash(content)] += 1
    return out


def tree(pages: DataFrame, html: str = "html", url: str = "url", min_pages: int = MIN_PAGES) -> DataFrame:
    """(place, n_pages, n_styles, importance) of the elements and leaf styles on ``min_pages`` or more pages of a host.

    Importance of an element is the entropy of its styles over its pages, of a leaf style one less the
    mean entropy of its contents over its pages; the base is the number of pages. Counts are combined
    before they move, so a host or an element with very many pages costs a row for each task.
    """

    def rows(total: Counter, curve: dict[tuple, float]) -> pa.RecordBatch:
        columns = [*zip(*total, strict=True), list(total.values()), [curve.get(f, 0.0) for f in total]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["place", "kind", "value", "n", "curve"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        curve: dict[tuple, float] = {}
        for batch in batches:
            for site, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for fact, n in facts(parse(text), site).items():
                    total[fact] += n
                    if n > 1:
                        curve[fact] = curve.get(fact, 0.0) + n * math.log(n)
                if len(total) >= _HELD:
                    yield rows(total, curve)
                    total.clear()
                    curve.clear()
        if total:
            yield rows(total, curve)

    counted = pages.select(site_of(url).alias("site"), F.col(html).alias("html"))
    counted = counted.mapInArrow(count, "place long, kind long, value long, n long, curve double")
    shown = counted.groupBy("place", "kind", "value").agg(F.sum("n").alias("n"), F.sum("curve").alias("curve"))
    is_style, is_feature = F.col("kind") == _STYLE, F.col("kind") == _FEATURE
    spread = F.log("n") - F.col("curve") / F.col("n")
    merged = shown.groupBy("place").agg(
        F.sum(F.when(~is_feature, F.col("n"))).alias("n_pages"),
        F.count(F.when(is_style, 1)).alias("n_styles"),
        F.sum(F.when(is_style, F.col("n") * F.log("n"))).alias("styles"),
        F.count(F.when(is_feature, 1)).alias("contents"),
        F.sum(F.when(is_feature, spread)).alias("spread"),
    )
    merged = merged.filter(F.col("n_pages") >= max(2, min_pages))
    base = F.log("n_pages")
    of_leaf = F.when(F.col("contents") == 0, 0.0).otherwise(1 - F.col("spread") / F.col("contents") / base)
    of_element = (base - F.col("styles") / F.col("n_pages")) / base
    importance = F.when(F.col("n_styles") > 0, of_element).otherwise(of_leaf)
    return merged.select("place", "n_pages", "n_styles", F.greatest(F.lit(0.0), importance).alias("importance"))


def branch_importance(page: Page, site: str, known: dict[int, tuple[float, int]]) -> list[float]:
    """Composite importance of every node: of its own presentation, and of what the page has below it.

    ``known`` holds (importance, styles) of the places in the tree; others count as important.
    """
    return _importance(*places(page, site), [node.parent for node in page.nodes], known)


def _importance(element: list[int], style: list[int], parent: list[int], known: dict[int, tuple[float, int]]) -> list[float]:
    out, below, children = [1.0] * len(element), [0.0] * len(element), [0] * len(element)
    for i in reversed(range(len(element))):
        if element[i] in known:
            own, styles = known[element[i]]
            under = below[i] / children[i] if children[i] else known.get(style[i], (1.0, 0))[0]
            weight = GAMMA**styles
            out[i] = (1 - weight) * own + weight * under
        if i:
            below[parent[i]] += out[i]
            children[parent[i]] += 1
    return out


def low_branches(parent: list[int], importance: list[float], threshold: float) -> list[bool]:
    """Of every node, whether it and all below it are of low importance."""
    low = [x < threshold for x in importance]
    for i in reversed(range(1, len(low))):
        low[parent[i]] &= low[i]
    return low


def _text(page: Page, keep: list[bool]) -> str:
    return "\n\n".join(text for i, text in page.blocks if keep[i])


def _whole_articles(page: Page, keep: list[bool], low: list[bool]) -> list[bool]:
    """``low`` for a page that names its articles: all of one is what the element named is, which goes only with everything below it."""
    out: list[bool] = []
    for i, node in enumerate(page.nodes):
        inside = i > 0 and keep[node.parent]
        out.append(keep[i] and (out[node.parent] if inside else low[i]))
    return out


def judged_text(page: Page, low: list[bool]) -> tuple[str, int]:
    """(text, branches that went): what roles and the tree, which finds the ``low`` nodes, leave of a page.

    An element named as the article stays whole, as what repeats in it may be quoted; but one that is dull
    all through, as a teaser on every page, goes. A page of which nothing would stay repeats another page
    rather than a template, and keeps what roles leave.
    """
    keep, is_open = page.kept()
    if not is_open:
        low = _whole_articles(page, keep, low)
    gone = [keep[i] and low[i] and (i == 0 or not low[page.nodes[i].parent]) for i in range(len(keep))]
    left = [k and not x for k, x in zip(keep, low, strict=True)]
    if any(left[i] for i, _ in page.blocks):
        return _text(page, left), sum(gone)
    return _text(page, keep), 0


def main_text(
    pages: DataFrame, html: str = "html", url: str = "url", threshold: float = THRESHOLD, min_pages: int = MIN_PAGES
) -> DataFrame:
    """``pages`` with ``main_text``, ``by_tree`` (the tree judged the page) and ``low_branches`` (how many it took out).

    Menus, headers, footers, sidebars, notices, adverts, forms, comments and scripts go by element, role,
    class or id. Of the rest, branches of low importance in the site style tree go; where elements are
    named as the article, their text is the rest, and such a branch is one of them. Blocks are joined in
    page order by two line ends, white space inside one is one space. Null and empty pages have an empty text, and pages without a host
    make up a site of their own; repeated rows stay. Columns keep their names, whatever they are.

    Pages of one site with the same elements are judged alike, so places are looked up and judged once for each
    such shape; only the shapes with something dull meet the pages again.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in pages.columns)).alias("row")
    named = pages.select(row, F.col(html).alias("html"), site_of(url).alias("site"))

    @F.pandas_udf("struct<key:long,element:array<long>,style:array<long>,parent:array<int>>")
    def shape(sites: pd.Series, column: pd.Series) -> pd.DataFrame:
        out = []
        for site, text in zip(sites, column, strict=True):
            page = parse(text)
            element, style = places(page, site)
            out.append((_hash(*element, *style), element, style, [node.parent for node in page.nodes]))
        return pd.DataFrame(out, columns=["key", "element", "style", "parent"])

    @F.pandas_udf("array<int>")
    def judged(elements: pd.Series, styles: pd.Series, parents: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for element, style, parent, found in zip(elements, styles, parents, known, strict=True):
            own = {} if found is None else {x["place"]: (x["importance"], x["n_styles"]) for x in found}
            low = low_branches(parent, _importance(element, style, parent, own), threshold)
            out.append([i for i, x in enumerate(low) if x])
        return pd.Series(out, dtype=object)

    @F.pandas_udf("struct<text:string,n:int,asked:boolean>")
    def by_tree(column: pd.Series, dull: pd.Series) -> pd.DataFrame:
        out = []
        for text, found in zip(column, dull, strict=True):
            page, gone = parse(text), set() if found is None else {int(i) for i in found}
            out.append((*judged_text(page, [i in gone for i in range(len(page.nodes))]), bool(page.blocks)))
        return pd.DataFrame(out, columns=["text", "n", "asked"])

    # Told to be of one use: else each field taken from it has a parse of its own.
    shaped = named.withColumn("shape", shape.asNondeterministic()("site", "html"))
    shaped = stored(shaped.select("row", "shape.*"), "shaped-pages")
    shapes = shaped.groupBy("key").agg(F.first(F.struct("element", "style", "parent")).alias("nodes")).select("key", "nodes.*")
    wanted = shapes.select("key", F.explode(F.array_distinct(F.concat("element", "style"))).alias("place"))
    found = wanted.join(tree(pages, html, url, min_pages), "place").groupBy("key")
    found = found.agg(F.collect_list(F.struct("place", "importance", "n_styles")).alias("known"))
    dull = judged.asNondeterministic()("element", "style", "parent", "known")
    dull = shapes.join(found, "key", "left").select("key", dull.alias("dull")).filter(F.size("dull") > 0)
    told = shaped.select("row", "key").join(stored(dull, "dull-shapes"), "key", "left")
    told = told.withColumn("told", by_tree.asNondeterministic()(F.col("row").getField(html), "dull"))
    return told.select(
        "row.*", F.col("told.text").alias("main_text"), F.col("told.asked").alias("by_tree"), F.col("told.n").alias("low_branches")
    )


def main_text_digest(pages: DataFrame) -> DataFrame:
    return main_text(pages).select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"), "by_tree", "low_branches"
    )
