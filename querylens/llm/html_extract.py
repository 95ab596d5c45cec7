"""HTML extraction with a site style tree.

The DOMs of a host are merged: elements with the same path of tags, classes and ids are one node. A node's content
importance is 1 minus the mean of ln(pages with this text) / ln(pages with the node) over its texts, so what all pages
repeat weighs 0 and what one page has weighs 1; an inner node takes the mean of the leaves below it, by occurrences. Its
presentation importance is the entropy, to the base of the number of its pages, of the ways in which its children are
arranged. Both are mixed as (1 - GAMMA**l) * presentation + GAMMA**l * content for l arrangements. Nodes seen on fewer than
``min_pages`` pages of the host take the values of the tree of all hosts.

Markup that names its role is prior knowledge: INSIDE is added at and below article and main, OUTSIDE taken off what is
elsewhere on a page that has one, and 1 taken off menus, headers, footers, sidebars, notices, adverts, forms and reader
comments. Blocks whose own element has a sum of prior and importance below ``least`` are removed from each page. Where too few
pages have a node to know its importance, markup alone decides: it stays, unless it stands outside a page's article or main.
On pages without one, html and body are never removed.

Counting works on (host, node, text) keys with partial sums, so a host with a third of all pages is no hot spot; verdicts
go back to pages by a broadcast of at most BROADCAST_NODES nodes or, beyond it, by a join in which the provably few hot
hosts are salted. Pages are read in one pass over their characters, whatever their markup.

Edge cases: null or empty html gives an empty text; broken and unclosed markup is read as browsers would, roughly: p, li,
table cells and options close their predecessors, an end tag closes up to its start tag or is ignored, a quote that
nothing closes is an ordinary character, a tag that the page's end cuts off is no text, elements deeper than DEPTH count
as their ancestor there; null urls share one host; pages are handled one by one, repeated or not, and pages of any length
whole; ties (importance equal to ``least``) stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querylens.llm._spark import HOT_SHARE, lookup, written
from querylens.sources.scratch import spread

GAMMA = 0.9
INSIDE, OUTSIDE = 0.2, 0.3

DEPTH = 512
#: Most nodes of known importance that are broadcast, and most pages of a hot host that one salt takes beyond that.
BROADCAST_NODES, SALT_PAGES = 500_000, 5_000
#: Most tags of a page whose quotes are weighed although a tag before had no end outside of quotes.
MISREAD = 16

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
#: The rest of a tag: quotes count where a value begins and if something closes them.
REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
#: Elements whose text is never shown, and those of them that end with the page if nothing closes them.
HIDDEN = frozenset("script style template noscript textarea title svg iframe select object canvas math".split())
RAW = frozenset("script style textarea title iframe".split())
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag closes these open elements, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
CLOSES_P = BLOCKS - {"br", "html", "head", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "summary"}
P_STOPS = frozenset({"td", "th", "table", "article", "section", "div", "aside", "nav", "main", "body", "button", "caption"})
NOISE_TAGS = frozenset("nav header footer aside form menu button dialog".split())
NOISE_NAMES = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|widgets?|header|masthead|footer|footnav|copyright|comments?|commentlist|replies|respond|disqus|discussion|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|pagination|pager|toolbar|skip)(?:$|[-_ \d])", re.I)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MAIN_TAGS = frozenset({"article", "main"})
WHITE = re.compile(r"\s+")


def code(text: str, seed: int = 0) -> int:
    """A 64-bit hash that all workers agree on."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(text, seed)).view(np.int64))


class Element:
    """``node`` names the path of tags, classes and ids from the top."""

    __slots__ = ("tag", "node", "prior", "removed", "main", "children", "names")

    def __init__(self, tag: str, names: str, parent: Element | None):
        self.tag, self.names, self.children = tag, names, []
        self.node = code(tag + names, parent.node & 0xFFFFFFFFFFFFFFFF if parent else 0)
        inside = parent is not None and parent.main
        self.main = inside or tag in MAIN_TAGS or " role:main" in names
        noise = noisy(tag, names, inside)
        self.removed = noise or (parent is not None and parent.removed)
        self.prior = -1 if noise else 1 if self.main else 0


def noisy(tag: str, names: str, inside: bool) -> bool:
    if tag in NOISE_TAGS:
        return tag != "header" or not inside  # an article's own header holds its heading
    if not names or tag in ("html", "body", "article", "main"):
        return False
    words = names.split()
    return any(w[5:] in NOISE_ROLES if w.startswith("role:") else NOISE_NAMES.search(w[1:]) is not None for w in words)


def names_of(attributes: str) -> str:
    """Classes, ids and roles as `` .class #id role:x``; digits do not tell nodes apart."""
    if "=" not in attributes:
        return ""
    out = []
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        for w in re.sub(r"\d+", "0", entities.unescape(a or b or c).lower()).split():
            out.append({"c": ".", "i": "#", "r": "role:"}[name[0].lower()] + w)
    return " " + " ".join(sorted(set(out))) if out else ""


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", characters, ""), ("open", tag, attributes) and ("close", tag, "") in order; each character is read once."""
    at, misread, unclosed = 0, 0, set()
    while at < len(page):
        begin = page.find("<", at)
        if begin < 0:
            yield "text", page[at:], ""
            return
        if begin > at:
            yield "text", page[at:begin], ""
        closing = page.startswith("/", begin + 1)
        name = NAME.match(page, begin + 1 + closing)
        if name is None:
            if page.startswith("<!--", begin):
                end, at = page.find("-->", begin + 2), 3
            elif page.startswith(("<!", "<?", "</"), begin):
                end, at = page.find(">", begin), 1
            else:
                yield "text", "<", ""
                at = begin + 1
                continue
            if end < 0:
                return
            at += end
            continue
        rest = REST.match(page, name.end()) if misread < MISREAD else None
        if rest is None:
            misread += 1
            end = page.find(">", name.end())
            if end < 0:
                return
            attributes, at = page[name.end() : end], end + 1
        else:
            attributes, at = rest[1], rest.end()
        tag = name[0].lower()
        if closing:
            yield "close", tag, ""
        elif tag not in HIDDEN or (tag in ("svg", "math") and attributes.endswith("/")):
            yield "open", tag, attributes
        elif tag not in unclosed:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*+(?:>|\\Z)", re.I).search(page, at)
            if end is not None:
                at = end.end()
            elif tag in RAW:
                return
            else:
                unclosed.add(tag)


def parsed(page: str) -> tuple[list[tuple[list[Element], str]], list[Element]]:
    """(text blocks with their chain of elements in page order, all elements)."""
    stack: list[Element] = []
    every: list[Element] = []
    blocks: list[tuple[list[Element], str]] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            text = WHITE.sub(" ", "".join(held)).strip()
            held.clear()
            if text:
                blocks.append((stack[:], text))

    def pop_to(index: int) -> None:
        if any(e.tag in BLOCKS for e in stack[index:]):
            flush()
        del stack[index:]

    deeper: dict[str, int] = {}
    for kind, tag, attributes in tokens(page):
        if kind == "text":
            held.append(entities.unescape(tag) if "&" in tag else tag)
            continue
        if kind == "close":
            if deeper.get(tag):
                deeper[tag] -= 1
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    pop_to(k)
                    break
            else:
                if tag in BLOCKS:
                    flush()
            continue
        if tag in BLOCKS:
            flush()
        if tag in CLOSES:
            own, stops = CLOSES[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in stops:
                    break
                if stack[k].tag in own:
                    pop_to(k)
                    break
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in P_STOPS:
                    break
                if stack[k].tag == "p":
                    pop_to(k)
                    break
        if tag in VOID or attributes.endswith("/"):
            continue
        if len(stack) >= DEPTH:
            deeper[tag] = deeper.get(tag, 0) + 1
            continue
        parent = stack[-1] if stack else None
        e = Element(tag, names_of(attributes), parent)
        if parent is not None:
            parent.children.append(tag + e.names)
        every.append(e)
        stack.append(e)
    flush()
    return blocks, every


NODE_SCHEMA = "host string, node long, leaf boolean, part long, n long"


def merged_nodes(frames):
    """(host, html) -> for each node (leaf: text block's own) and text or arrangement: on how many of the pages it is."""
    for pdf in frames:
        seen: dict[tuple, int] = {}
        for host, page in zip(pdf["host"], pdf["html"], strict=True):
            blocks, every = parsed(page or "")
            own = set()
            for chain, text in blocks:
                part = code(text)
                own.update((e.node, True, part) for e in chain)
            own.update((e.node, False, code(",".join(dict.fromkeys(e.children)))) for e in every)
            for node, leaf, part in own:
                key = (host, node, leaf, part)
                seen[key] = seen.get(key, 0) + 1
        yield pd.DataFrame([(*key, n) for key, n in seen.items()], columns=["host", "node", "leaf", "part", "n"])


def importances(nodes: DataFrame) -> DataFrame:
    """(host, node, pages, importance) of one tree for each host."""
    parts = nodes.groupBy("host", "node", "leaf", "part").agg(F.sum("n").alias("n"))
    node = parts.groupBy("host", "node").agg(
        F.sum(F.when(~F.col("leaf"), F.col("n"))).alias("pages"),
        F.count(F.when(~F.col("leaf"), 1)).alias("styles"),
        F.sum(F.when(~F.col("leaf"), F.col("n") * F.log(F.col("n").cast("double")))).alias("style_sum"),
        F.sum(F.when(F.col("leaf"), F.col("n"))).alias("texts"),
        F.sum(F.when(F.col("leaf"), F.col("n") * F.log(F.col("n").cast("double")))).alias("text_sum"),
    )
    m = F.log(F.col("pages").cast("double"))
    content = F.when(F.col("texts").isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.col("text_sum") / F.col("texts") / m))
    presentation = (m - F.col("style_sum") / F.col("pages")) / m
    damp = F.pow(F.lit(GAMMA), F.col("styles"))
    return node.select("host", "node", "pages", F.when(F.col("pages") > 1, (1 - damp) * presentation + damp * content).otherwise(F.lit(1.0)).alias("importance"))


def page_text(page: str | None, known: dict[int, float], least: float) -> str:
    """The blocks of a page that stay; ``known`` has the importance of the host's nodes that enough pages have."""
    if not page:
        return ""
    blocks, every = parsed(page)
    has_main = any(e.main and not e.removed for e in every)
    out = []
    for chain, text in blocks:
        if any(e.tag == "head" or e.removed for e in chain):
            continue
        # A branch goes only if all below it is of low importance, so a block's own element decides.
        own = chain[-1] if chain else None
        inside = own is not None and own.main
        if own is not None and (has_main or own.tag not in ("html", "body")):
            found = known.get(own.node)
        else:
            found = None
        if found is None:
            if has_main and not inside:
                continue
        elif (INSIDE if inside else -OUTSIDE if has_main else 0.0) + found < least:
            continue
        out.append(text)
    return "\n".join(out)


def html_extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = 0.35, min_pages: int = 8) -> DataFrame:
    """page_id, url, text, n_chars."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    nodes = pages.select("host", "html").mapInPandas(merged_nodes, NODE_SCHEMA)
    # Partial sums before the shuffle; every node counts for its host and for the tree of all hosts.
    nodes = written(nodes.groupBy("host", "node", "leaf", "part").agg(F.sum("n").alias("n")), "nodes")
    own = written(importances(nodes), "own")
    whole = importances(nodes.withColumn("host", F.lit("*"))).select("node", F.col("pages").alias("all_pages"), F.col("importance").alias("all_importance"))
    hosts_of = own.groupBy("node").agg(F.count("*").alias("rows"))
    whole = written(whole.join(hosts_of, "node"), "whole")
    rows = own.count()
    both = lookup(own, whole, ["node"], "rows", rows, "left")
    value = F.when(F.col("pages") >= min_pages, F.col("importance")).when(F.col("all_pages") >= min_pages, F.col("all_importance"))
    known = both.filter(value.isNotNull()).groupBy("host").agg(F.collect_list(F.struct("node", value.alias("value"))).alias("x")).select("host", "x.node", "x.value")
    counts = nodes.filter("not leaf").groupBy("host").agg(F.max("n").alias("n"))
    known = written(known.join(counts, "host"), "known")

    def texts(frames):
        held: dict = {}
        for pdf in frames:
            out = []
            for h, page, nodes_, values in zip(pdf["host"], pdf["html"], pdf["node"], pdf["value"], strict=True):
                if h not in held:
                    if len(held) > 10_000:
                        held.clear()
                    held[h] = {} if nodes_ is None else {int(x): float(v) for x, v in zip(nodes_, values, strict=True)}
                out.append(page_text(page, held[h], least))
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": out, "n_chars": [len(x) for x in out]})

    if (known.agg(F.sum(F.size("node") + 1)).first()[0] or 0) <= BROADCAST_NODES:
        ready = pages.join(F.broadcast(known.drop("n")), "host", "left")
    else:  # hosts with at least HOT_SHARE of all pages, at most 1 / HOT_SHARE of them, are salted
        many = max(1, int(pages.count() * HOT_SHARE))
        hot = F.broadcast(known.filter(F.col("n") >= many).select("host", F.ceil(F.col("n") / SALT_PAGES).cast("int").alias("salts")))
        salts = F.coalesce("salts", F.lit(1))
        dealt = known.join(hot, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts", "n")
        ready = pages.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), salts).cast("int")).join(dealt, ["host", "salt"], "left")
    return ready.select("page_id", "url", "host", "html", "node", "value").mapInPandas(texts, "page_id long, url string, text string, n_chars long")


def op6_html_extract(spark, sf_dir: str) -> DataFrame:
    return html_extract(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))
