"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node is a path of elements with
their class and id (numbers in them count as one), so nodes of one presentation fall together.
A node's importance, in bits, is the entropy of its presentation over the different texts it has had,
plus the logarithm of the words it usually holds.  The presentation is the elements of the
whole branch and the magnitude of its text.  Its content entropy is that of its text over the pages, as a
share of what as many different pages could have.

Children of a node are judged against the most important of them, which is never noise; what stands directly
in the node, such as paragraphs and headings, counts as one child and isn't noise either.  Another
branch is noise if its text repeats from page to page while that of the best child doesn't, or
if the best child is a branch too and this one has less than a share LEAST_IMPORTANCE of its importance:
a template's slot looks alike on all pages.  Noise is left out of each page that has the best child as well.

What a site fills with much text of its own, such as reader comments, entropy can't tell from
the main text; elements and their names say so, and such parts are left out too.
Hosts of too few pages for a tree have nothing else, and there the text is
taken from an article or main element, where a page has one.

Trees are merged by counting, never by gathering a host's pages: what leaves a
worker is a row for each node and distinct look of a batch, and one page's text
depends on the noisy nodes of its host alone.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A node is judged on this many pages of its host or more.
LEAST_PAGES = 8
#: Share of the best child's importance below which a branch is noise.
LEAST_IMPORTANCE = 0.5
#: Share of the greatest content entropy below which a branch repeats.
LEAST_CONTENT = 0.2
#: Elements nested deeper become siblings, as browsers have it.
DEPTH = 512
#: Pages of one host are joined with its noisy nodes in this many parts.
SALTS = 32

#: Elements of HTML by what they mean here.
DROPPED = {"script", "style", "noscript", "template", "head", "nav", "header", "footer", "aside", "form", "button", "select", "textarea", "input", "iframe", "svg", "canvas", "object", "menu", "dialog", "title"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Branches that a style tree judges; all else is content that stands directly in them.
BRANCHES = {"address", "article", "aside", "center", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "header", "hgroup", "main", "menu", "nav", "ol", "search", "section", "table", "ul"}
#: A start of these ends an open p.
ENDS_P = BLOCKS - {"body", "html", "caption", "legend", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup", "dd", "dt", "li"} | {"li", "dd", "dt"}
#: A start ends an open element of its own kind, up to the element that may hold both.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of a class or id that name a part beside the main text.
_BESIDE = re.compile(r"(?:^|[^a-z])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|menu|nav\w*|breadcrumbs?|sidebar\w*|side|widget|related|recommend\w*|comments?|commentlist|respond|replies|disqus|share|sharing|social|footer|header|masthead|topbar|toolbar|pagination|pager|skip|copyright|legal|search\w*|toc)(?:$|[^a-z])", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*))")
_PLAIN_END = re.compile(r"[^>\"']*>")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NUMBER = re.compile(r"[0-9]+")


class Node:
    __slots__ = ("beside", "chars", "children", "label", "look", "name", "parent", "path", "text", "words")

    def __init__(self, name: str, label: str, parent: Node | None, beside: bool):
        self.name, self.label, self.parent, self.beside, self.children = name, label, parent, beside, []
        self.path = _hash(label, parent.path if parent else 0)


def _hash(label: str, before: int) -> int:
    return int.from_bytes(hashlib.blake2b(before.to_bytes(8, "big", signed=True) + label.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


class _Tags:
    """The tags of a page, in time linear in its length: each search begins where the last one ended, and none that failed is done again."""

    def __init__(self, page: str):
        self.page, self.unquoted = page, set()

    def end(self, at: int) -> int:
        """The place after the > that ends a tag whose inside begins at `at`, or -1; > in quotes that close doesn't count."""
        page = self.page
        if m := _PLAIN_END.match(page, at):
            return m.end()
        while m := _STOP.search(page, at):
            at, mark = m.end(), m[0]
            if mark == ">":
                return at
            if mark not in self.unquoted:
                close = page.find(mark, at)
                if close < 0:
                    self.unquoted.add(mark)  # nor is there any further on
                else:
                    at = close + 1
        return -1


def _looks(name: str, text: str) -> tuple[str, bool]:
    """The element's label in the style tree, and whether its name puts it beside the main text."""
    beside = name in DROPPED
    if not text or text.isspace():
        return name, beside
    found = {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(text)}
    names = f"{found.get('class', '')} {found.get('id', '')}".strip()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I) is not None
    role = found.get("role", "").lower() in _ROLES
    named = name not in {"html", "body", "article", "main", "p", "h1", "h2", "h3", "h4", "h5", "h6", "em", "strong", "b", "i"} and _BESIDE.search(names) is not None
    return f"{name}.{_NUMBER.sub('0', names)}" if names else name, beside or hidden or role or named


def parse(page: str) -> Node:
    """The tree of a page; unclosed and stray tags are taken as browsers do, nearly."""
    root = Node("", "", None, False)
    stack, done, n, tags = [root], 0, len(page), _Tags(page)
    while done < n:
        m = _OPEN.search(page, done)
        if m is None:
            stack[-1].children.append(html.unescape(page[done:]))
            break
        if m.start() > done:
            stack[-1].children.append(html.unescape(page[done : m.start()]))
        if m[2] is None:
            close = "-->" if m[0] == "<!--" else ">"
            at = page.find(close, m.end())
            done = n if at < 0 else at + len(close)
            continue
        done = tags.end(m.end())
        if done < 0:  # the page ends inside of a tag
            break
        name, inside = m[2].lower(), page[m.end() : done - 1]
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
                if stack[k].name in BLOCKS and name not in BLOCKS:
                    break
            continue
        if name in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    del stack[k:]
                    break
                if stack[k].name in BLOCKS:
                    break
        if name in SIBLINGS:
            ends, holders = SIBLINGS[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in holders:
                    break
                if stack[k].name in ends:
                    del stack[k:]
                    break
        label, beside = _looks(name, inside)
        node = Node(name, label, stack[-1], beside)
        stack[-1].children.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, done)
            done = n if close is None else close.start()
        elif name not in VOID and not inside.endswith("/") and len(stack) < DEPTH:
            stack.append(node)
    return root


def _walk(root: Node):
    """Elements of the tree in page order, each with whether it stands within one that is beside the main text."""
    todo = [(root, False)]
    while todo:
        node, within = todo.pop()
        yield node, within
        todo += [(c, within or node.beside) for c in reversed(node.children) if isinstance(c, Node)]


def _direct(node: Node) -> int:
    """The path of what stands directly in a node, outside of branches."""
    return _hash("#", node.path)


def _magnitude(chars: int) -> int:
    """How often a length can be divided by 4."""
    return (chars + 1).bit_length() // 2


def _measure(root: Node) -> None:
    """Give each element hashes of its branch's presentation and text, and the branch's words and characters."""
    for node in reversed([x for x, _ in _walk(root)]):
        look = text = words = chars = 0
        for c in node.children if node.name not in RAW else ():
            if isinstance(c, Node):
                look = zlib.crc32(c.label.encode("utf-8", "replace") + c.look.to_bytes(4, "big"), look)
                if c.chars:
                    text, words, chars = zlib.crc32(c.text.to_bytes(4, "big"), text), words + c.words, chars + c.chars
            elif not c.isspace():
                own = c.split()
                text = zlib.crc32(" ".join(own).encode("utf-8", "replace"), text)
                words, chars = words + len(own), chars + sum(map(len, own))
        node.look, node.text, node.words, node.chars = look, text, words, chars


def seen_nodes(root: Node) -> dict[tuple[int, int, bool], tuple[int, int, int]]:
    """(parent's path, path, whether it is a branch): hashes of presentation and text, and words, of all that a page has there."""
    _measure(root)
    sums: dict[tuple[int, int, bool], list[int]] = {}
    for parent, _ in _walk(root):
        branches = [c for c in parent.children if isinstance(c, Node) and c.name in BRANCHES]
        if not branches:
            continue
        direct = [0, 0, 0, 0]
        for c in parent.children:
            if isinstance(c, str):
                if not c.isspace():
                    own = c.split()
                    direct = [direct[0], zlib.crc32(" ".join(own).encode("utf-8", "replace"), direct[1]), direct[2] + len(own), direct[3] + sum(map(len, own))]
                continue
            if not c.chars:
                continue
            if c.name in BRANCHES:
                x = sums.setdefault((parent.path, c.path, True), [0, 0, 0, 0])
            else:
                x = direct
            x[0] = zlib.crc32(c.label.encode("utf-8", "replace") + c.look.to_bytes(4, "big"), x[0])
            x[1] = zlib.crc32(c.text.to_bytes(4, "big"), x[1])
            x[2], x[3] = x[2] + c.words, x[3] + c.chars
        if direct[3]:
            x = sums.setdefault((parent.path, _direct(parent), False), [0, 0, 0, 0])
            x[0], x[1] = zlib.crc32(direct[0].to_bytes(4, "big"), x[0]), zlib.crc32(direct[1].to_bytes(4, "big"), x[1])
            x[2], x[3] = x[2] + direct[2], x[3] + direct[3]
    return {k: (zlib.crc32(bytes([_magnitude(chars)]), look), text, words) for k, (look, text, words, chars) in sums.items()}


def host_of(url: str):
    """The lower-cased host of a column of URLs, without user, port and a leading www; empty where there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(found), r"^www\.", "")


def noise_paths(pages: DataFrame, least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE, least_content: float = LEAST_CONTENT) -> DataFrame:
    """(host, noise): for each host with a style tree its noisy branches, by (parent, path, best child of the parent).

    The entropy of counts n of a total m is log m - sum(n log n) / m.  Nodes on fewer than least_pages
    pages are not judged; a host without any other node has no row.
    """

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            words: dict = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for key, (look, text, n) in seen_nodes(parse(page or "")).items():
                    counts[host, *key, look, text] += 1
                    words[host, *key, look, text] = n
            rows = list(zip(*((*k, n, words[k]) for k, n in counts.items()), strict=True)) or [()] * 8
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["host", "parent", "path", "branch", "look", "text", "n", "words"])

    node = ["host", "parent", "path", "branch"]
    told = pages.select(host_of("url").alias("host"), "html").mapInArrow(run, "host string, parent long, path long, branch boolean, look long, text long, n long, words long")
    texts = told.groupBy(*node, "look", "text").agg(F.sum("n").alias("n"), F.max("words").alias("words"))
    looks = texts.groupBy(*node, "look").agg(F.count("*").alias("d"), F.sum("n").alias("n"), F.sum(F.col("n") * F.log2("n")).alias("s"), F.sum("words").alias("words"))
    sums = looks.groupBy(*node).agg(F.sum("n").alias("m"), F.sum("d").alias("d"), F.sum(F.col("d") * F.log2("d")).alias("ds"), F.sum("s").alias("s"), F.sum("words").alias("words")).filter(F.col("m") >= least_pages)
    content = 1 - F.col("s") / (F.col("m") * F.log2("m"))
    importance = F.log2("d") - F.col("ds") / F.col("d") + F.log2(1 + F.col("words") / F.col("d"))
    judged = common.stored(sums.select(*node, content.alias("content"), importance.alias("importance")))
    best = judged.groupBy("host", "parent").agg(F.max(F.struct("importance", "path", "branch", "content")).alias("best"))
    other = judged.filter("branch").join(best, ["host", "parent"]).filter(F.col("path") != F.col("best.path"))
    repeats = (F.col("content") < least_content) & (F.col("content") < F.col("best.content") / 2)
    slot = F.col("best.branch") & (F.col("importance") < least_importance * F.col("best.importance"))
    noise = other.filter(repeats | slot).groupBy("host").agg(F.collect_list(F.struct("parent", "path", F.col("best.path").alias("best"))).alias("noise"))
    return judged.select("host").distinct().join(noise, "host", "left").select("host", F.coalesce("noise", F.array().cast("array<struct<parent:long,path:long,best:long>>")).alias("noise"))


def main_text(page: str | None, noise: dict[tuple[int, int], int] | None = None, *, by_name: bool = True, counts: Counter | None = None) -> str:
    """Blocks of the main text, white space inside each joined to one space, with a line feed between them.

    noise has the best sibling of each noisy (parent, path); None for a host without a tree.  Without by_name the tree alone decides.
    `counts` is told how many branches the tree left out.
    """
    root = parse(page or "")
    kept: list[Node] = []
    for name in ("article", "main") if noise is None and by_name else ():
        inside: set[int] = set()
        for node, within in _walk(root):
            if node.name == name and not within and not node.beside and id(node) not in inside:
                kept.append(node)
                inside.update(id(x) for x, _ in _walk(node))
        if kept:
            break
    blocks, part = [], []

    def flush():
        if line := " ".join("".join(part).split()):
            blocks.append(line)
        part.clear()

    def noisy(node: Node, parent: Node) -> bool:
        best = noise.get((parent.path, node.path)) if noise else None
        if best is None:
            return False
        if best == _direct(parent):
            found = any(not c.isspace() if isinstance(c, str) else c.name not in BRANCHES and c.chars for c in parent.children)
        else:
            found = any(isinstance(c, Node) and c.path == best and c.chars for c in parent.children)
        if found and counts is not None:
            counts["branches"] += 1
        return found

    if noise:
        _measure(root)
    never = RAW | {"head", "noscript", "template"} if not by_name else set()
    for top in kept or [root]:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                part.append(x)
            elif x.name == "br":
                part.append(" ")
            elif x is top or not (x.beside if by_name else x.name in never) and not (x.name in BRANCHES and noisy(x, x.parent)):
                if x.name in BLOCKS or x is top:
                    flush()
                    todo.append(None)
                todo += reversed(x.children)
        flush()
    return "\n".join(blocks)


def extract(pages: DataFrame, *, least_pages: int = LEAST_PAGES, least_importance: float = LEAST_IMPORTANCE, least_content: float = LEAST_CONTENT, by_name: bool = True) -> DataFrame:
    """page_id, url, text and n_noise, the branches that the style tree left out, for each row of pages (page_id, url, html).

    A null or empty page has an empty text; a null url counts as a host without a name.
    Repeated rows are handled each for itself and count as pages of their host.
    A node that fewer than least_pages pages of a host have is never noise.  Without by_name
    no element's name, class or role decides, but for scripts, styles and the like.
    """
    spark = pages.sparkSession
    common.bounded_batches(spark)
    pages = pages.select("page_id", "url", "html")
    noise = common.stored(noise_paths(pages, least_pages, least_importance, least_content))

    def run(batches):
        for batch in batches:
            texts, left_out = [], []
            for page, found in zip(batch.column("html").to_pylist(), batch.column("noise").to_pylist(), strict=True):
                counts: Counter = Counter()
                texts.append(main_text(page, None if found is None else {(x["parent"], x["path"]): x["best"] for x in found}, by_name=by_name, counts=counts))
                left_out.append(counts["branches"])
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(left_out, pa.int64())], ["page_id", "url", "text", "n_noise"])

    salted = noise.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = pages.withColumns({"host": host_of("url"), "salt": F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")})
    joined = keyed.join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "noise")
    return joined.mapInArrow(run, pages.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_noise")).schema)


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main texts of the whole pages table."""
    found = extract(common.table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_noise")
