"""Main text of HTML pages by a site style tree.

The element trees of all pages of a host are merged: elements with the same path of labels (tag, id, class)
are one node. Pages of hosts with under MIN_PAGES pages are pooled by their template, the set of labels down to
DEPTH levels, over all such hosts. For each node the pages that have it, its child sequences (presentation) and the
text blocks under it (content) are counted. With m pages, presentation importance is the entropy, to base m, of the
child sequences; novelty is one minus the mean of log_m(pages that share the block), over the words under the node;
and a node's share is its part of all novel words of its host. A node's importance is
(1 - g^l) * presentation + g^l * content for l children and g = 0.9, with novelty as the content: a node that shows
the same on every page comes to 0, one that differs on each page to 1. Branches below LEAST are cut from every page.

Words of a class or id that speak of noise (NOISE_NAMES, all parts of the word) are no more than a prior: such a node
has to hold a share of what is new on the host, so its share is its content, and LEAST_NAMED is asked of it. An
advert with changing text goes, for it holds little of a site's text; a section of that name that holds most, stays.

Elements that can hold no main text by their tag or role (navigation, headers, footers, asides, forms, scripts, styles,
hidden ones) never count. Prose, lists and tables are never cut for their importance alone, only as part of a branch.
A page whose host and template are both known from too few pages is judged by the priors alone: named nodes go, and
an article, else a main element, with text stands for the page.

Text is cut into blocks at block-level tags; references are decoded, white space inside a block becomes one
space, blocks are joined by an empty line.

The tree is counted by Spark (per host, path and hash, pre-aggregated); only branches to cut are brought to the
pages: as a task argument up to MAX_CUTS rows (each path has up to MAX_PATH characters), by joins beyond. Nodes deeper
than MAX_PATH characters have a hash for the rest of their path, so they stay apart; they go only with a branch
above them.

Defined cases: null HTML is empty; a page without text gives an empty string; a null URL belongs to the host
""; a host without anything new keeps all; every row gives one result row; an empty table gives an empty result.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenscope.llm.common import OWN, map_batches, table
from tokenscope.llm.urls import host_and_path

LEAST, LEAST_NAMED, MIN_PAGES, GAMMA, DEPTH = 0.3, 0.5, 4, 0.9, 3
MAX_CUTS, MAX_PATH, MAX_LABEL = 20_000, 4000, 40

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
NOISE_TAGS = frozenset("head nav header footer aside form script style noscript template iframe object svg canvas button select textarea input dialog menu audio video datalist label search".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs pagination pager header masthead "
    "footer sidebar aside cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe signup login search share sharing social related recommended "
    "comment comments reply replies respond disqus".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Parts of a name that say nothing of what an element is.
NEUTRAL_NAMES = frozenset("area bar block box btn button buttons container content footer group header inner item items left link links list main outer page panel post right section site top widget wrap wrapper".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th caption figure figcaption b i em strong a span code".split())
RAW = re.compile(r"(script|style|textarea|title|noscript|template|iframe|xmp|noembed|noframes)\Z")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_token = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?",
    re.S,
)
_attribute = re.compile(r"\b(id|class|role|hidden|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_names = re.compile(r"[a-z]+")
_closes_raw: dict[str, re.Pattern] = {}

#: What an open tag of the key closes in its parent, besides an open paragraph.
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
FENCE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


class Node:
    """An open element: its tag, path, whether it can hold no main text, whether its name speaks of noise, the kind of content element it is inside, its children's labels."""

    __slots__ = ("children", "inside", "named", "noise", "path", "tag")

    def __init__(self, tag: str, path: str, noise: bool, named: bool, inside: str) -> None:
        self.tag, self.path, self.noise, self.named, self.inside, self.children = tag, path, noise, named, inside, []


def speaks_of_noise(name: str) -> bool:
    """Whether a class or id is made of noise words, and of words that say nothing, alone: related or cookie-bar, but not related-work."""
    parts = _names.findall(name)
    return any(p in NOISE_NAMES for p in parts) and all(p in NOISE_NAMES or p in NEUTRAL_NAMES for p in parts)


def label(tag: str, attributes: str) -> tuple[str, bool, bool, str]:
    """(label, beyond MAX_LABEL characters a hash, ending in ! if named, whether it is noise by tag or role, whether its name speaks of noise, role) of an element."""
    noise, named, role, names = tag in NOISE_TAGS, False, "", [tag]
    if "=" in attributes or "hidden" in attributes:
        for name, a, b, c in _attribute.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name == "role":
                role = value.strip()
                noise = noise or role in NOISE_ROLES
            elif name == "hidden" or name == "aria-hidden":
                noise = noise or (name == "hidden" or value == "true")
            else:
                for x in sorted(value.split()):
                    names.append(("#" if name == "id" else ".") + x.replace("/", "_"))
                    named = named or speaks_of_noise(x)
    text = "".join(names)
    if len(text) > MAX_LABEL:
        text = f"{tag}.~{xxhash.xxh3_64_hexdigest(text.encode())}"
    return text + "!" * named, noise, named, role


def path_of(parent: str, name: str) -> str:
    """Path of a child. Beyond MAX_PATH characters a hash of all labels below stands for them."""
    path = f"{parent}/{name}"
    if len(path) <= MAX_PATH and "/~" not in parent:
        return path
    top, _, rest = parent.partition("/~")
    return f"{top}/~{xxhash.xxh3_64_hexdigest(f'{rest}/{name}'.encode())}"


def walk(page: str) -> Iterator[tuple[str, Node, str]]:
    """Events in page order: ("open", node, ""), ("close", node, ""), ("text", node, raw text) and ("break", node, "") at block borders."""
    root = Node("", "", False, False, "")
    stack, at, size = [root], 0, len(page)
    # open elements by tag, so that the stack is searched only for what is in it
    opened: Counter = Counter()

    def close_to(depth: int) -> Iterator[tuple[str, Node, str]]:
        while len(stack) > depth:
            node = stack.pop()
            opened[node.tag] -= 1
            if node.tag in BLOCK:
                yield "break", node, ""
            yield "close", node, ""

    while at < size:
        start = page.find("<", at)
        if start < 0:
            start = size
        if start > at:
            yield "text", stack[-1], page[at:start]
        if start == size:
            break
        m = _token.match(page, start)
        if m is None:
            yield "text", stack[-1], "<"
            at = start + 1
            continue
        at = m.end()
        slash, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if slash:
            if opened[tag]:
                yield from close_to(next(depth for depth in range(len(stack) - 1, 0, -1) if stack[depth].tag == tag))
            elif tag in BLOCK:
                yield "break", stack[-1], ""
            continue
        if tag in BLOCK:
            for depth in range(len(stack) - 1, 0, -1) if opened["p"] else ():
                if stack[depth].tag == "p":
                    yield from close_to(depth)
                    break
                if stack[depth].tag in BLOCK:
                    break
            if tag in HEADINGS and stack[-1].tag in HEADINGS:
                yield from close_to(len(stack) - 1)
        if tag in SAME and any(opened[x] for x in SAME[tag]):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in SAME[tag]:
                    yield from close_to(depth)
                    if tag != "tr" or not any(opened[x] for x in SAME[tag]):
                        break
                elif stack[depth].tag in FENCE[tag]:
                    break
        parent = stack[-1]
        if tag in VOID:
            parent.children.append(tag)
            yield ("break", parent, "") if tag in BLOCK else ("text", parent, " " if tag == "br" else "")
            continue
        name, noise, named, role = label(tag, attributes)
        if tag == "header" and parent.inside == "article" and role not in NOISE_ROLES and "hidden" not in attributes:
            # an article's own header holds its title
            noise = False
        parent.children.append(name)
        inside = "article" if tag == "article" else "main" if tag == "main" or role == "main" else ""
        node = Node(tag, path_of(parent.path, name), noise or parent.noise, named or parent.named, parent.inside if parent.inside == "article" or not inside else inside)
        if tag in BLOCK:
            yield "break", parent, ""
        stack.append(node)
        opened[tag] += 1
        yield "open", node, ""
        if RAW.match(tag):
            end = _closes_raw.setdefault(tag, re.compile(f"</{tag}\\s*>", re.I)).search(page, at)
            if tag in ("textarea", "title"):
                yield "text", node, page[at : end.start() if end else size]
            at = end.end() if end else size
            yield from close_to(len(stack) - 1)
        elif attributes.endswith("/") and tag in ("svg", "math", "path"):
            yield from close_to(len(stack) - 1)
    yield from close_to(1)


def blocks(page: str, cut: frozenset[str] | None = frozenset()) -> list[tuple[Node, str]]:
    """(node of the first text, text) of every block outside noise and outside branches in cut (None: outside named nodes), and outside nothing else."""
    out: list[tuple[Node, str]] = []
    buffer: list[str] = []
    first: Node | None = None
    removed: list[Node] = []

    for kind, node, text in walk(page):
        if kind == "text":
            if not node.noise and not removed:
                buffer.append(text)
                if first is None and not text.isspace():
                    first = node
        elif kind == "break":
            if buffer:
                if clean := " ".join(html_lib.unescape("".join(buffer)).split()):
                    out.append((first or node, clean))
                buffer, first = [], None
        elif kind == "open":
            if (node.named if cut is None else node.path in cut) and not node.noise:
                removed.append(node)
        elif removed and removed[-1] is node:
            removed.pop()
    if buffer and (clean := " ".join(html_lib.unescape("".join(buffer)).split())):
        out.append((first, clean))
    return out


def main_text(page: str, cut: frozenset[str] | None = None) -> str:
    """The page's text as the tree leaves it; without a tree (None), by the priors: without named nodes, cut to its articles, else its main element, where they hold a third of its text or more."""
    found = blocks(page, cut)
    if cut is None:
        for kind in ("article", "main"):
            inside = [t for n, t in found if n is not None and n.inside == kind]
            if inside and 3 * sum(map(len, inside)) >= sum(len(t) for _, t in found):
                return "\n\n".join(inside)
    return "\n\n".join(t for _, t in found)


def template(page: str) -> str:
    """A key of the page's labels down to DEPTH levels."""
    labels = {n.path for kind, n, _ in walk(page) if kind == "close" and n.path.count("/") <= DEPTH and n.tag not in PROSE}
    return "t:" + xxhash.xxh3_64_hexdigest("\n".join(sorted(labels)).encode())


def counts(page: str) -> tuple[str, list[tuple[str, str, int, int]]]:
    """The page's template and (path, kind, number, words) for the style tree.

    "m" once per node of the page with its most children, "s" for each child sequence (a hash), "c" once for each text block of the page (a hash).
    """
    most: dict[str, int] = {}
    labels: set[str] = set()
    rows: list[tuple[str, str, int, int]] = []
    for kind, node, _ in walk(page):
        if kind == "close":
            if node.path.count("/") <= DEPTH and node.tag not in PROSE:
                labels.add(node.path)
            if not node.noise:
                most[node.path] = max(most.get(node.path, 0), len(node.children))
                rows.append((node.path, "s", xxhash.xxh3_64_intdigest("|".join(node.children).encode()) >> 1, 0))
    rows += [(path, "m", n, 0) for path, n in most.items()]
    rows += {(node.path, "c", xxhash.xxh3_64_intdigest(text.encode()) >> 1, text.count(" ") + 1) for node, text in blocks(page)}
    return "t:" + xxhash.xxh3_64_hexdigest("\n".join(sorted(labels)).encode()), rows


def style_tree(pages: DataFrame) -> DataFrame:
    """site (h: and a host, or t: and a template of small hosts), path, m, importance of every node outside noise, known from MIN_PAGES pages or not."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        total: Counter = Counter()
        for url, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            host = "h:" + host_and_path(url)[0]
            kind, rows = counts(page or "")
            total[host, kind, "", "n", 0, 0] += 1
            for row in rows:
                total[host, kind, *row] += 1
        rows = list(zip(*total))
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
        names = ["host", "template", "path", "kind", "x", "words", "n"]
        return pa.RecordBatch.from_arrays([*(pa.array(list(x), type=k) for x, k in zip(rows, kinds)), pa.array(list(total.values()), type=pa.int64())], names=names)

    each = map_batches(pages.select("url", "html"), one, "host string, template string, path string, kind string, x long, words long, n long")
    each = each.groupBy("host", "template", "path", "kind", "x", "words").agg(F.sum("n").alias("n")).checkpoint()
    size = each.where("kind = 'n'").groupBy("host").agg(F.sum("n").alias("pages"))
    each = each.where("kind <> 'n'").join(size.checkpoint(), "host")
    site = F.when(F.col("pages") >= MIN_PAGES, F.col("host")).otherwise(F.col("template")).alias("site")
    each = each.select(site, "path", "kind", "x", "words", "n").groupBy("site", "path", "kind", "x", "words").agg(F.sum("n").alias("n"))
    log, of = F.log(F.col("n").cast("double")), lambda kind: F.col("kind") == kind
    content = F.col("n") * F.col("words")
    own = each.groupBy("site", "path").agg(
        F.sum(F.when(of("m"), F.col("n"))).alias("m"),
        (F.sum(F.when(of("m"), F.col("n") * F.col("x"))) / F.sum(F.when(of("m"), F.col("n")))).alias("l"),
        F.sum(F.when(of("s"), F.col("n"))).alias("s_n"),
        F.sum(F.when(of("s"), F.col("n") * log)).alias("s_log"),
        F.sum(F.when(of("c"), content)).alias("c_n"),
        F.sum(F.when(of("c"), content * log)).alias("c_log"),
    ).checkpoint()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    base = F.log(F.greatest("m", F.lit(2)).cast("double"))
    held = own.where("c_n is not null and m is not null").select("site", "path", "c_n", (F.col("c_n") * F.greatest(F.lit(0.0), 1 - F.col("c_log") / F.col("c_n") / base)).alias("new"))
    total = held.groupBy("site").agg(F.sum("new").alias("all_new"))
    under = held.select("site", F.explode(above).alias("path"), "c_n", "new").groupBy("site", "path").agg(F.sum("c_n").alias("c_n"), F.sum("new").alias("new"))
    nodes = own.where("m is not null").drop("c_n", "c_log").join(under, ["site", "path"], "left").join(total, "site", "left")
    style = F.greatest(F.lit(0.0), F.log(F.col("s_n").cast("double")) - F.col("s_log") / F.col("s_n")) / base
    part = F.when(F.endswith("path", F.lit("!")), F.col("all_new")).otherwise(F.col("c_n"))
    text = F.coalesce(F.try_divide("new", part), F.lit(0.0))
    weight = F.pow(F.lit(GAMMA), F.col("l"))
    nothing = (F.col("m") < 2) | (F.coalesce("all_new", F.lit(0.0)) <= 0)
    importance = F.when(nothing, 1.0).otherwise(F.least(F.lit(1.0), (1 - weight) * style + weight * text))
    return nodes.select("site", "path", "m", importance.alias("importance"))


def cuts(tree: DataFrame) -> DataFrame:
    """site, path of the branches to cut, and a row with an empty path for each site that has MIN_PAGES pages."""
    tag = F.regexp_extract("path", r"/([a-z0-9-]+)[^/]*$", 1)
    least = F.when(F.endswith("path", F.lit("!")), LEAST_NAMED).otherwise(LEAST)
    cut = (F.col("importance") < least) & ~tag.isin("html", "body", *PROSE) & ~F.contains("path", F.lit("/~"))
    known = tree.where(F.col("m") >= MIN_PAGES)
    return known.where(cut).select("site", "path").union(known.select("site", F.lit("").alias("path")).distinct())


def extract(pages: DataFrame, keep: list[str], max_cuts: int = MAX_CUTS) -> DataFrame:
    """Columns keep of pages with _ts_text."""
    gone = cuts(style_tree(pages)).checkpoint()
    n = len(keep)
    kept = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep)
    few = gone.limit(max_cuts + 1).collect()
    source = pages.select(*[pages[k] for k in keep], pages["url"].alias(OWN + "url"), pages["html"].alias(OWN + "html"))
    known: dict[str, frozenset[str]] = {}
    if len(few) <= max_cuts:
        for r in few:
            known.setdefault(r.site, set()).add(r.path)
        known = {k: frozenset(v) for k, v in known.items()}
    else:
        lists = gone.groupBy("site").agg(F.collect_set("path").alias("cut")).checkpoint()
        source = map_batches(source, _with_sites, f"{kept}, {OWN}url string, {OWN}html string, {OWN}host string, {OWN}template string")
        for name in ("host", "template"):
            source = source.join(lists.toDF(OWN + name, f"{OWN}{name}_cut"), OWN + name, "left")
        source = source.select(*keep, OWN + "url", OWN + "html", F.coalesce(f"{OWN}host_cut", f"{OWN}template_cut").alias(OWN + "cut"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        urls, texts = batch.column(n).to_pylist(), [t or "" for t in batch.column(n + 1).to_pylist()]
        if batch.num_columns > n + 2:
            sets = [None if x is None else frozenset(x) for x in batch.column(n + 2).to_pylist()]
        else:
            sets = [known.get("h:" + host_and_path(u)[0]) for u in urls]
            sets = [known.get(template(t)) if c is None else c for t, c in zip(texts, sets)]
        out = [main_text(t, c) for t, c in zip(texts, sets)]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), pa.array(out, type=pa.string())], names=[*keep, OWN + "text"])

    return map_batches(source, one, f"{kept}, {OWN}text string")


def _with_sites(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with the sites of its pages: host and template."""
    urls, texts = batch.column(OWN + "url").to_pylist(), batch.column(OWN + "html").to_pylist()
    hosts, kinds = ["h:" + host_and_path(u)[0] for u in urls], [template(t or "") for t in texts]
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(hosts, type=pa.string()), pa.array(kinds, type=pa.string())], names=[*batch.schema.names, OWN + "host", OWN + "template"])


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"), ["page_id", "url"])
    return out.select("page_id", "url", F.col(OWN + "text").alias("text"), F.length(OWN + "text").cast("long").alias("n_chars"))
