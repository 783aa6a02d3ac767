"""HTML extraction with site style trees.

Pages of one host are merged into a style tree: its nodes are paths of elements
(tag and first class), each with the presentations (sequences of child tags) and
the contents that pages show there. A node's importance is high where both
differ from page to page and low where pages repeat them (entropy over the
host's pages). Branches of low importance leave each page, as do those whose
element or class says what they are. What is left of the article, if a page
marks one, else of the body, is the text. Inside an article a branch of low
importance leaves only where its own content repeats too, and articles that
share their longest block (copies of each other) count once.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames

#: Pages of a host that a node must stand in, and their share, before its importance counts;
#: least importance of a branch that stays; weight of content against presentation.
LEAST_PAGES, LEAST_SHARE, IMPORTANT, CONTENT = 5, 0.2, 0.3, 0.75
#: Rows of the table of unimportant nodes that are sent to all machines.
FEW = 50_000

# Fixed values of HTML: elements without content, without text of the page, that break lines, that
# end an open paragraph or item, and whose content isn't markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe object svg canvas math head title select option button input textarea form fieldset dialog audio video".split())
RAW = frozenset("script style title textarea noscript iframe template xmp".split())
BLOCK = frozenset("html body address article aside blockquote caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
# Elements, roles and words of classes and ids that say what a branch is.
ASIDE = frozenset("nav aside footer menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation topnav menu submenu breadcrumb breadcrumbs "
    "sidebar side rail footer foot header masthead topbar cookie cookies consent gdpr notice notices alert popup popover modal overlay newsletter subscribe subscription signup login "
    "share sharing social follow related recommended recommendations teaser comment comments disqus replies respond pagination pager widget toolbar skip paywall form search copyright".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "path", "children", "aside", "main")

    def __init__(self, tag, path, aside, main):
        self.tag, self.path, self.children, self.aside, self.main = tag, path, [], aside, main


def _node(tag: str, attributes: str, parent: Node) -> Node:
    name, aside = "", tag in SILENT or tag in ASIDE
    if attributes and not attributes.isspace():
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), (a or b or c).lower()
            if key in ("class", "id"):
                if tag not in ("html", "body", "main"):
                    aside = aside or any(w in NAMES for w in _PARTS.findall(value))
                name = name or value.split(" ")[0]
            elif key == "role":
                aside = aside or value in ROLES
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                aside = True
    if tag == "header" and not parent.main:
        aside = True
    label = f"{tag}.{name}" if name else tag
    path = f"{parent.path}/{label}"
    # long paths by their hash: different nodes stay different
    return Node(tag, path if len(path) <= 400 else f"#{hash_of(path)}", aside and tag != "article", parent.main or tag in ("article", "main"))


def parse(page: str) -> Node:
    """The tree of a page: children are nodes and texts. Elements left open end with their parents;
    an unfinished tag at the page's end is dropped."""
    root = Node("", "", False, False)
    stack, at, n = [root], 0, len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            stack[-1].children.append(page[at:])
            break
        m = _TOKEN.match(page, start)
        if not m:
            if re.match(r"</?[a-zA-Z]", page[start : start + 3]) and page.find(">", start) < 0:
                stack[-1].children.append(page[at:start])
                break
            stack[-1].children.append(page[at : start + 1])
            at = start + 1
            continue
        if start > at:
            stack[-1].children.append(page[at:start])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in BLOCK or tag == "a":
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                    if tag not in ("html", "body", "article", "main") and stack[k].tag in ("article", "main", "body"):
                        break
            else:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                    if stack[k].tag in BLOCK:
                        break
            continue
        if tag in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        elif tag in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SCOPES[tag]:
                    break
                if stack[k].tag in SIBLINGS[tag]:
                    del stack[k:]
                    break
        node = _node(tag, attributes, stack[-1])
        stack[-1].children.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            if not end:
                break
            at = page.find(">", end.start()) + 1 or n
            continue
        stack.append(node)
    return root


def text_of(node: Node) -> str:
    """All text below a node, white space as one space."""
    parts, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        else:
            todo.extend(reversed(x.children))
    return _SPACE.sub(" ", " ".join(parts)).strip()


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def _content(node: Node) -> str:
    """The text below a node, or its length and hash if it is long."""
    text = text_of(node)
    return text if len(text) < 200 else f"{len(text)}:{hash_of(text)}"


def _longest(node: Node) -> str:
    """Hash of the longest text of an article's blocks that hold no other block."""
    best, todo = "", [node]
    while todo:
        x = todo.pop()
        below = [c for c in x.children if isinstance(c, Node) and not c.aside]
        todo.extend(below)
        if not any(c.tag in BLOCK for c in below):
            best = max(best, text_of(x), key=len)
    return hash_of(best)


def _style(root: Node) -> set[tuple[str, str, str, str]]:
    """(article, path, presentation, content) of the page's nodes outside known branches.
    article: its longest block's hash, empty outside articles."""
    found, todo = set(), [(c, "") for c in root.children if isinstance(c, Node)]
    while todo:
        x, once = todo.pop()
        if x.aside:
            continue
        if x.main and not once:
            once = _longest(x)
        shape = ",".join(dict.fromkeys(c.tag for c in x.children if isinstance(c, Node)))
        if x.tag not in ("html", "body") and (text := _content(x)):
            found.add((once, x.path, shape, text))
        todo.extend((c, once) for c in x.children if isinstance(c, Node))
    return found


def hash_of(text: str) -> str:
    import hashlib

    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=12).hexdigest()


def blocks(root: Node, low: frozenset[str] | set[str] = frozenset()) -> list[str]:
    """The blocks of a page's main text. low: unimportant nodes of its host, as paths, in articles
    as path, line feed and hash of the content. An article that would leave no text stays whole."""
    inside = {p.rpartition("\n")[0] for p in low}
    mains, todo = [], [root]
    while todo:
        x = todo.pop()
        if x.aside:
            continue
        if x.tag in ("article", "main"):
            mains.append(x)
            continue
        todo.extend(c for c in reversed(x.children) if isinstance(c, Node))
    out: list[str] = []
    line: list[str] = []

    def end():
        if text := _SPACE.sub(" ", html.unescape("".join(line))).strip():
            out.append(text)
        line.clear()

    def unimportant(x: Node) -> bool:
        if not x.main:
            return x.path in low
        return x.path in inside and f"{x.path}\n{hash_of(_content(x))}" in low

    def walk(node: Node, prune: bool = True):
        # each entry: a text, a node, or None where a block ends
        rest: list = list(reversed(node.children))
        while rest:
            x = rest.pop()
            if x is None:
                end()
            elif isinstance(x, str):
                line.append(x)
            elif x.aside or (prune and unimportant(x)):
                if x.tag in BLOCK:
                    end()
            elif x.tag == "br":
                line.append(" ")
            else:
                if x.tag in BLOCK:
                    end()
                    rest.append(None)
                rest.extend(reversed(x.children))
        end()

    for m in mains or [root]:
        before = len(out)
        walk(m)
        if m.main and len(out) == before:
            walk(m, prune=False)
    return out


def _features(batches):
    for rb in batches:
        counts: Counter = Counter()
        for host, page in zip(rb.column("host").to_pylist(), rb.column("html").to_pylist(), strict=True):
            counts[host, "", "", "n", ""] += 1
            mine: Counter = Counter()
            for once, path, shape, text in _style(parse(page or "")):
                mine[host, once, path, "c", hash_of(text)] = 1
                mine[host, once, path, "p", hash_of(shape)] += 1
                mine[host, once, path, "s", ""] = 1
                if once:
                    mine[host, once, "", "a", ""] = 1
            for k, n in mine.items():
                counts[k] = max(counts[k], n) if k[1] else counts[k] + n
        rows = [(*k, n) for k, n in counts.items()]
        for s in range(0, len(rows), 20_000):
            host, once, path, kind, feature, n = zip(*rows[s : s + 20_000], strict=True)
            yield frames.batch(host=pa.array(host, pa.string()), once=pa.array(once, pa.string()), path=pa.array(path, pa.string()), kind=pa.array(kind, pa.string()), feature=pa.array(feature, pa.string()), n=pa.array(n, pa.int64()))


def _counted(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """host, path, kind, feature, inside (an article) and n: pages, or different articles, with contents
    (c), presentations (p), the path at all (s); of the host, its pages (n) and articles (a)."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    source = pages.select(host.alias("host"), F.col(html_col).cast("string").alias("html"))
    found = source.mapInArrow(_features, "host string, once string, path string, kind string, feature string, n long")
    inside = F.col("once") != ""
    single = found.groupBy("host", "once", "path", "kind", "feature").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    single = single.select("host", "path", "kind", "feature", inside.alias("inside"), F.when(inside, F.col("most")).otherwise(F.col("n")).alias("n"))
    return single.groupBy("host", "path", "kind", "feature", "inside").agg(F.sum("n").alias("n"))


def _nodes(counted: DataFrame) -> DataFrame:
    # entropy of one feature over m pages that show it: log(n) / log(m); of presentations: their diversity
    kinds = counted.where("kind IN ('c', 'p', 's')").groupBy("host", "path", "inside", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    kinds = kinds.withColumn("repeat", F.when(F.col("m") > 1, F.col("s") / (F.col("m") * F.log("m"))).otherwise(0.0))
    nodes = kinds.groupBy("host", "path", "inside").agg(F.max(F.when(F.col("kind") == "s", F.col("m"))).alias("pages"), F.max(F.when(F.col("kind") == "c", 1 - F.col("repeat"))).alias("content"), F.max(F.when(F.col("kind") == "p", 1 - F.col("repeat"))).alias("presentation"))
    totals = counted.where("kind IN ('n', 'a')").select("host", (F.col("kind") == "a").alias("inside"), F.col("n").alias("host_pages"))
    importance = F.lit(CONTENT) * F.col("content") + F.lit(1 - CONTENT) * F.col("presentation")
    return nodes.join(totals, ["host", "inside"]).select("host", "path", "inside", "pages", "host_pages", importance.alias("importance"))


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Nodes of all hosts' style trees: host, path, inside (an article), pages (that show it; inside,
    different articles), host_pages (likewise) and importance, 0 to 1."""
    return _nodes(_counted(pages, url_col, html_col))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: id, url and text, the main text's blocks joined by a line
    feed. Null pages have empty text; pages without a url form one site. Columns not named
    are left out; rows that repeat each count as a page, but equal articles as one."""
    counted = frames.staged(_counted(frames.small_batches(pages), url_col, html_col), "style-counts")
    enough = (F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= F.col("host_pages") * LEAST_SHARE)
    low = _nodes(counted).where(enough & (F.col("importance") < IMPORTANT))
    repeated = counted.where("inside AND kind = 'c'").where(F.col("n") >= LEAST_PAGES).select("host", "path", "inside", "feature", "n")
    within = low.where("inside").join(repeated, ["host", "path", "inside"]).where(F.col("n") >= F.col("host_pages") * LEAST_SHARE)
    low = low.where("NOT inside").select("host", "path").unionByName(within.select("host", F.concat_ws("\n", "path", "feature").alias("path")))
    low = frames.staged(low.groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("low")), "style-tree")
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    source = pages.select(F.struct(F.col(id_col), F.col(url_col)).alias("own"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    few = (low.agg(F.sum(F.size("low"))).first()[0] or 0) <= FEW
    joined = source.join(F.broadcast(low) if few else low, "host", "left")

    def rows(batches):
        for rb in batches:
            out, size, since = [], 0, 0
            for i, (page, paths) in enumerate(zip(rb.column("html"), rb.column("low"), strict=True)):
                text = "\n".join(blocks(parse(page.as_py()), set(paths.as_py() or ()))) if page.is_valid else ""
                out.append(text)
                size += len(text)
                if size >= 8 << 20 or i == rb.num_rows - 1:
                    yield frames.batch(own=rb.column("own").slice(since, len(out)), text=pa.array(out, pa.string()))
                    since, out, size = i + 1, [], 0

    kind = source.schema["own"].dataType.simpleString()
    out = joined.select("own", "html", "low").mapInArrow(rows, f"own {kind}, text string")
    return out.select(F.col(f"own.`{id_col}`").alias(id_col), F.col(f"own.`{url_col}`").alias(url_col), "text")


