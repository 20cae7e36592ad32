"""Main text of web pages by site template removal.

Two passes parse every page to a tree. The first hashes element subtrees and counts, per host, on how many
pages with different main parts each occurs, also by section (the first folder of the path); a subtree that
recurs on many pages of its host or section is template. A subtree has two hashes: of its texts, and of its shape
(tags, classes, ids and the kinds of its children, with the texts masked), because menus and adverts recur with
other words. Shapes count only beside the article or main part of the page, and only where they hold no prose. Where a page
marks no such part, that is the innermost container that still has half of its prose (of its text outside of links, if
no paragraph or heading marks prose), and a shape counts with its place, the path from the root; on pages without any prose
shapes don't count. Headings, paragraphs and list items count like any other subtree by their texts, in an article too;
parts of a sentence and cells of an article's table only go with the block that holds them.
The second pass deletes template subtrees from the whole page. Then come the checks that need no counts: parts
that HTML itself marks as no content (menus, headers, footers, asides, forms, scripts, notices, adverts, comments)
go, and where the page marks its article or main part, only what is left of that is the text.

Defined results: null or empty html gives ''; a null url is a host of its own; repeated rows are each
returned; pages of any length are read whole. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A subtree is template if it is on so many different pages of its host and such a share of them,
LEAST_PAGES, LEAST_SHARE = 5, 0.3
#: or on so many and a far smaller share, for chance repeats of short lines grow with the host,
MANY_PAGES, SMALL_SHARE = 50, 0.01
#: or, in a section (the first folder of the path), on so many of it and LEAST_SHARE.
SECTION_PAGES = 10
#: So many words in a row, beside the main part of a page that marks none, are prose.
PROSE_WORDS = 25
#: Template tables up to so many hashes are sent to all tasks; larger ones are joined by shuffle.
BROADCAST_HASHES = 200_000

# HTML's element classes.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Parts of a line or of a row: not a block of their own.
PARTS = {"a", "abbr", "b", "cite", "code", "em", "i", "mark", "q", "s", "small", "span", "strong", "sub", "sup", "td", "th", "u"}
#: Elements that may hold prose.
PROSE = {"article", "blockquote", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "main", "p", "pre", "table"}
WHOLE_PAGE = {"#root", "html", "body", "head", "article", "main"}
#: Opening the key ends an open element of the values, up to the nearest container.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = {"article", "aside", "body", "div", "dl", "footer", "form", "header", "html", "main", "nav", "ol", "section", "select", "table", "ul"}
ENDS_P = BLOCK - {"body", "caption", "html", "legend", "option", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
NO_CONTENT = {"aside", "audio", "button", "canvas", "dialog", "footer", "form", "head", "input", "menu", "nav", "object", "select", "svg", "template", "video"} | RAW
NO_CONTENT_NAMES = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "login", "modal", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promotion", "related", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe"}
#: Words that may stand beside those names in a class or id ("share-buttons", "left-sidebar", "related-posts"); with
#: any other word ("no-sidebar", "social-impact", "related-work") it is no such name.
BESIDE_NAMES = {"area", "article", "articles", "bar", "block", "bottom", "box", "button", "buttons", "container", "content", "entry", "form", "icons", "inner", "left", "links", "list", "main", "message", "outer", "overlay", "page", "popup", "post", "posts", "primary", "right", "secondary", "section", "site", "slot", "top", "unit", "widget", "widgets", "wrap", "wrapper"}
#: Only these are dropped by name; headings, paragraphs and parts of lines never are.
NAMED = {"article", "aside", "details", "div", "dl", "figure", "footer", "header", "ol", "section", "table", "ul"}
NO_CONTENT_WHOLE = {"footer", "header", "menu", "nav", "toolbar"}
NO_CONTENT_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search"}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)>?""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parts", "parent", "hash", "shape", "marked", "own")

    def __init__(self, tag: str, attrs: str, parent: "Node | None"):
        self.tag, self.attrs, self.parts, self.parent, self.hash, self.shape, self.own = tag, attrs, [], parent, 0, 0, b""
        self.marked = parent is not None and (parent.marked or parent.tag in ("article", "main"))


def parse(source: str) -> Node:
    """A tolerant tree: parts are strings and nodes. End tags without a start are left out; elements that
    the end tag of an ancestor passes, or the end of the text, are closed."""
    root = at = Node("#root", "", None)
    place = 0
    for m in iter(lambda: TOKEN.search(source, place), None):
        if m.start() > place:
            at.parts.append(entities.unescape(source[place : m.start()]))
        place = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            up = at
            while up is not root and up.tag != tag:
                up = up.parent
            if up is not root:
                at = up.parent
            continue
        ends = ENDS.get(tag) or ({"p"} if tag in ENDS_P else None)
        if ends:
            up = at
            while up.tag not in ends and up.tag not in CONTAINERS and up is not root:
                up = up.parent
            if up.tag in ends:
                at = up.parent
        node = Node(tag, m[3], at)
        at.parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[^>]*>?", re.I).search(source, place)
            node.parts.append(source[place : end.start() if end else len(source)])
            place = end.end() if end else len(source)
        elif tag not in VOID:
            at = node
    if place < len(source):
        at.parts.append(entities.unescape(source[place:]))
    return root


def _nodes(root: Node) -> list[Node]:
    """All elements, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in node.parts if isinstance(x, Node)]
    return out


def names(node: Node) -> set[str]:
    """The words of its classes and id that name something besides the content."""
    found: set[str] = set()
    if node.attrs and node.tag in NAMED:
        for name, *values in ATTRIBUTE.findall(node.attrs):
            if name.lower() in ("class", "id"):
                for x in max(values, key=len).lower().split():
                    words = {w for w in re.split(r"[^a-z0-9]+", x) if w}
                    if x in NO_CONTENT_WHOLE or words <= NO_CONTENT_NAMES | BESIDE_NAMES and not ("content" in words and "sidebar" in words):
                        found |= {x} if x in NO_CONTENT_WHOLE else words & NO_CONTENT_NAMES
    return found


def no_content(node: Node, in_article: bool) -> bool:
    if node.tag in NO_CONTENT or node.tag == "header" and not in_article:
        return True
    if not node.attrs or node.tag in ("html", "body", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(node.attrs):
        name, value = name.lower(), max(values, key=len)
        if name == "role" and value.lower() in NO_CONTENT_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return bool(names(node))


def content_roots(nodes: list[Node]) -> list[Node]:
    """The outermost articles; else the main elements; else those in a part with the name of a layout; else the
    whole page. Comments' and related articles don't count."""
    if not any(n.tag in ("article", "main") for n in nodes):
        return nodes[:1]
    # what stands above each node, parents first
    above: dict[int, set[str]] = {id(nodes[0]): set()}
    for n in nodes[1:]:
        up = n.parent
        own = {up.tag} if up.tag in ("article", "main", "aside", "footer", "nav", "template") else set()
        own |= names(up) & {"comment", "comments", "related", "sidebar"}
        above[id(n)] = above[id(up)] | own if own else above[id(up)]
    off = {"aside", "footer", "nav", "template", "comment", "comments", "related"}
    for beside in (off | {"sidebar"}, off):
        for tag in ("article", "main"):
            found = [n for n in nodes if n.tag == tag and above[id(n)].isdisjoint(beside | {tag}) and not no_content(n, True)]
            if found:
                order = {id(n): i for i, n in enumerate(_in_order(nodes[0]))}
                return sorted(found, key=lambda n: order[id(n)])
    return nodes[:1]


def _in_order(root: Node) -> Iterator[Node]:
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [x for x in reversed(node.parts) if isinstance(x, Node)]


def _number(h) -> int:
    return int.from_bytes(h.digest(), "big", signed=True)


def hashed(nodes: list[Node]) -> None:
    """Set the hash of every subtree (tag, class and id, texts and children in order), and the shape of those that are
    beside the marked part and hold no prose; it is 0 for the others."""
    for node in reversed(nodes):
        own = node.tag
        if node.attrs:
            own += " " + " ".join(max(v, key=len) for n, *v in ATTRIBUTE.findall(node.attrs) if n.lower() in ("class", "id"))
        node.own = own = own.encode("utf-8", "replace")
        h = hashlib.blake2b(own, digest_size=8)
        kinds: dict[int, None] = {}
        plain = not node.marked and node.tag not in PROSE
        for x in node.parts:
            if isinstance(x, Node):
                h.update(b"\x00" + x.hash.to_bytes(8, "big", signed=True))
                kinds[x.shape] = None
                plain = plain and x.shape != 0
            else:
                text = SPACE.sub(" ", x).strip()
                h.update(b"\x01" + text.encode("utf-8", "replace"))
                if text:
                    kinds[1] = None
        node.hash = _number(h)
        if plain:
            node.shape = _number(hashlib.blake2b(own + b"\x02" + repr(list(kinds)).encode(), digest_size=8, person=b"shape"))


def placed(nodes: list[Node]) -> None:
    """For a page that marks no main part: shapes get their place, and only those keep one that are beside the main part
    and hold no long run of words. Shapes must be set."""
    sizes: dict[int, tuple[int, int, int, int]] = {}  # characters in prose, outside of links, words in a row, most of these
    for node in reversed(nodes):
        own = [x for x in node.parts if isinstance(x, str)] if node.tag not in RAW else []
        text = sum(len(x.strip()) for x in own)
        prose, free, row, most = 0, text, sum(len(x.split()) for x in own), 0
        for x in node.parts:
            if isinstance(x, Node) and x.tag not in NO_CONTENT:
                of = sizes[id(x)]
                prose, free, most = prose + of[0], free + of[1], max(most, of[3])
                row += of[2] if x.tag in PARTS else 0
        sizes[id(node)] = (free if node.tag in PROSE else prose, 0 if node.tag == "a" else free, row, max(row, most))
    main = nodes[0]
    weight = 0 if sizes[id(main)][0] else 1
    if weight and sizes[id(main)][3] < PROSE_WORDS:  # nothing tells which part is the main one
        for node in nodes:
            node.shape = 0
        return
    while True:
        inner = [x for x in main.parts if isinstance(x, Node) and x.tag not in PROSE and x.tag not in PARTS and x.tag not in NO_CONTENT]
        best = max(inner, key=lambda x: sizes[id(x)][weight], default=None)
        if best is None or not 0 < sizes[id(main)][weight] <= 2 * sizes[id(best)][weight]:
            break
        main = best
    kept, up = {id(n) for n in _nodes(main)}, main
    while up is not None:
        kept.add(id(up))
        up = up.parent
    paths = {id(nodes[0]): b""}
    for node in nodes:
        if node.parent is not None:
            paths[id(node)] = hashlib.blake2b(paths[id(node.parent)] + node.own, digest_size=8).digest()
        if node.shape:
            keep = id(node) in kept or sizes[id(node)][3] >= PROSE_WORDS
            node.shape = 0 if keep else _number(hashlib.blake2b(paths[id(node)] + node.shape.to_bytes(8, "big", signed=True), digest_size=8, person=b"place"))


def removable(node: Node) -> bool:
    """May be template by itself."""
    if node.tag in WHOLE_PAGE or node.tag in VOID or node.tag in RAW:
        return False
    return node.tag not in PARTS or not node.marked and not any(isinstance(x, str) and x.strip() for x in node.parent.parts)


def candidates(source: str) -> tuple[int, set[int]]:
    """The hash of the page's main part, and those of the subtrees that may be template."""
    nodes = _nodes(parse(source))
    hashed(nodes)
    roots = content_roots(nodes)
    main = hashlib.blake2b(repr([r.hash for r in roots]).encode(), digest_size=8)
    if roots[0].tag == "#root":
        placed(nodes)
    free = [n for n in nodes if removable(n)]
    return _number(main), {n.hash for n in free} | {n.shape for n in free if n.shape}


def extract(source: str, template: set[int]) -> str:
    return extracted(source, template)[0]


def extracted(source: str, template: set[int]) -> tuple[str, int]:
    """The text, and how many template subtrees were deleted."""
    nodes = _nodes(parse(source))
    if template:
        hashed(nodes)
    roots = content_roots(nodes)
    marked = roots[0].tag != "#root"
    if template and not marked:
        placed(nodes)
    starts = {id(r) for r in roots}
    blocks: list[str] = []
    now: list[str] = []
    removed, inside = 0, not marked

    def end() -> None:
        text = SPACE.sub(" ", "".join(now)).strip()
        if text:
            blocks.append(text)
        now.clear()

    todo: list = [nodes[0]]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif x is False:
            end()
            inside = False
        elif isinstance(x, str):
            if inside:
                now.append(x)
        else:
            root = marked and id(x) in starts
            if template and not root and (x.hash in template or x.shape and x.shape in template) and removable(x):
                removed += 1
                if x.tag in BLOCK:
                    end()
                continue
            if inside and not root and x is not nodes[0] and no_content(x, marked):
                if x.tag in BLOCK:
                    end()
                continue
            if root:
                end()
                inside = True
                todo.append(False)
            elif x.tag == "br":
                now.append(" ")
            elif x.tag in BLOCK:
                end()
                todo.append(None)
            todo += reversed(x.parts)
    end()
    return "\n".join(blocks), removed


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def section(url: Column) -> Column:
    """The first folder of the path, with a slash before it, or just the slash."""
    return F.concat(F.lit("/"), F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1), F.lit("")))


def templates(pages: DataFrame) -> DataFrame:
    """host, section, hash: the subtrees that recur on many different pages of the host (section '') or of the
    section. A host has at most 1 / SMALL_SHARE times a page's number of subtrees of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, parts, mains, hashes = [], [], [], []
            for name, part, source in zip(*(batch.column(k).to_pylist() for k in range(3))):
                main, own = candidates(source or "")
                for h in (0, *own):  # 0 counts the pages themselves
                    names.append(name)
                    parts.append(part)
                    mains.append(main)
                    hashes.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.string()), pa.array(hashes, pa.int64()), pa.array(mains, pa.int64())], ["host", "section", "hash", "main"])

    seen = pages.select(host(F.col("url")).alias("host"), section(F.col("url")).alias("section"), "html").mapInArrow(run, "host string, section string, hash long, main long")
    # a main part in several sections counts once, in the first
    once = seen.groupBy("host", "hash", "main").agg(F.min("section").alias("section"))
    each = once.select("host", "hash", F.explode(F.array(F.lit(""), F.col("section"))).alias("section"))
    counts = stored(each.groupBy("host", "section", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES), "subtrees")
    total = counts.where("hash = 0").select("host", "section", F.col("n").alias("pages"))
    n, share = F.col("n"), F.col("n") / F.col("pages")
    in_section = (n >= SECTION_PAGES) & (share >= LEAST_SHARE)
    on_host = (share >= LEAST_SHARE) | ((n >= MANY_PAGES) & (share >= SMALL_SHARE))
    return counts.where("hash <> 0").join(total, ["host", "section"]).where(F.when(F.col("section") == "", on_host).otherwise(in_section)).select("host", "section", "hash")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_removed (template subtrees) of every row of ``pages`` (page_id, url, html)."""
    found = stored(templates(pages), "templates")
    keyed = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"), section(F.col("url")).alias("section"))
    small: dict[tuple[str, str], set[int]] | None = None
    if found.count() <= BROADCAST_HASHES:
        small = {}
        for r in found.collect():
            small.setdefault((r.host, r.section), set()).add(r.hash)
        none = F.lit(None).cast("array<long>")
        keyed = keyed.withColumn("hashes", none).withColumn("more", none)
    else:  # Spark splits the pages of a large host, which is on the left side
        lists = found.groupBy("host", "section").agg(F.collect_list("hash").alias("hashes"))
        keyed = keyed.join(lists.where("section = ''").select("host", "hashes"), "host", "left")
        keyed = keyed.join(lists.where("section <> ''").withColumnRenamed("hashes", "more"), ["host", "section"], "left")
    shared = pages.sparkSession.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                text, removed = [], []
                for source, name, folder, hashes, more in zip(*(part.column(k).to_pylist() for k in range(2, 7))):
                    template = {*(hashes or ()), *(more or ())} if known is None else known.get((name, ""), set()) | known.get((name, folder), set())
                    for column, v in zip((text, removed), extracted(source or "", template)):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64()), pa.array(removed, pa.int64())], ["page_id", "url", "text", "n_chars", "n_removed"])

    kind = dict(pages.dtypes)["page_id"]
    chosen = keyed.select("page_id", "url", "html", "host", "section", "hashes", "more")
    return chosen.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_removed long")
