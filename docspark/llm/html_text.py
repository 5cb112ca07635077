"""Main text of web pages by composite text density.

A page becomes a tree. Elements and roles that hold no article text by definition go. Each remaining node gets its characters per tag,
damped by the share of its links in relation to the page's, and weighed down where class, id or role name boilerplate. The node whose
children's densities have the greatest sum is chosen. The least density on its way up to the body is the threshold: every part of the
page that reaches it gives its own greatest-sum subtree too, so text in several places is found. An article element around the chosen
node that is denser than the page comes whole, and so does the main heading that stands before the way up. Named parts inside go if
their weighed density is below the threshold. A name is no evidence, and all is weighed again without it, where the chosen node lies
in what it names, or where it names most of what was chosen. The blocks in page order are the text.

Defined cases: null and empty pages, and pages without text, give an empty text; a page of any length is read whole in linear time; the
first of several equal sums wins; rows are independent, so repeated rows repeat and an empty table stays empty; an input column named
like the output is replaced, other columns are carried along.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, texts

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements that hold no article text.
DROPPED = frozenset("head script style template noscript iframe noembed noframes svg object canvas audio video nav header footer aside form menu button select textarea input dialog title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
#: Words of class or id that name such parts.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer "
    "sidebar side aside widget widgets notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login form search "
    "comment comments commentlist respond reply replies disqus discussion share sharing social related recommended pagination pager toolbar skip".split()
)
#: Words that say nothing of what a part holds, only where or how it stands: with one of NAMES they leave it a name.
NEUTRAL = frozenset(
    "site page main top bottom left right list area slot box block wrapper wrap container inner outer content section col column row bar links link item items "
    "posts post results result open closed text title fixed sticky id js small large mobile desktop".split()
)
#: What a name takes from the density of what it names; talk of readers can rightly hold far more text than the article.
NAMED, TALKED = 0.05, 0.0005
#: Names of talk.
TALK = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
#: After one of these, a name tells of a layout: has-sidebar, no-comments.
QUALIFIERS = frozenset("no not non has have with without".split())
KEPT = frozenset("html body article main".split())
CLOSES_P = BLOCKS - frozenset("body html tbody td tfoot th thead tr caption dd dt li".split())
#: What a start tag ends, and what shields it.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "tr": (("tr",), ("table", "tbody", "thead", "tfoot"))}
ENDS |= dict.fromkeys(("dd", "dt"), (("dd", "dt"), ("dl",))) | dict.fromkeys(("td", "th"), (("td", "th"), ("tr", "table")))
#: As in the HTML tokenizer, a quote opens a value only right after the '=' of an attribute; elsewhere it is a plain character.
TAG = re.compile(
    r"""<(?:!--|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+)>|[!?/][^>]*>)"""
)
#: For a tag whose quotes take in all the rest of the page: it ends at the next '>'.
SHORT_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "parts", "drop", "weight", "plain", "chars", "tags", "link_chars", "link_tags", "density", "total", "peak")

    def __init__(self, tag: str, parent: Node | None, drop: str = ""):
        self.tag, self.parent, self.drop = tag, parent, drop
        self.parts: list[Node | str] = []

    def nodes(self) -> list[Node]:
        return [x for x in self.parts if not isinstance(x, str)]


def boilerplate(tag: str, attributes: str, in_article: bool) -> str:
    """What speaks against a node: ``!`` (its element or role), or a word of its names; empty if nothing does."""
    if tag in DROPPED:
        return "form" if tag == "form" else "" if tag == "header" and in_article else "!"
    if tag in KEPT or "=" not in attributes:
        return ""
    found = ""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "role" and (role := value.strip().lower()) in ROLES:
            if role != "form":
                return "!"
            found = found or role
        elif name in ("class", "id"):
            for token in value.split():
                own = []
                for word in map(str.lower, NAME.findall(token)):
                    if word in QUALIFIERS:
                        break
                    own.append(word)
                if all(w in NAMES or w in NEUTRAL for w in own):
                    found = found or next((w for w in own if w in NAMES), "")
    return found


class Open:
    """The open elements, and for each tag where it stands among them."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {}
        self.blocks = [0]  # blocks but p, which shield what is outside from the end tags of inline elements

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCKS and node.tag != "p":
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, tags: tuple[str, ...]) -> int:
        return max((found[-1] for t in tags if (found := self.at.get(t))), default=0)

    def close(self, at: int) -> None:
        while len(self.stack) > at:
            node = self.stack.pop()
            self.at[node.tag].pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()

    def end(self, tags: tuple[str, ...], shield: int) -> None:
        """End the latest open element of ``tags``, if it stands above ``shield``, with all it holds."""
        if (at := self.last(tags)) > shield:
            self.close(at)


def parse(page: str) -> Node:
    """The tree of a page; open elements end where the language implies it, stray end tags are ignored."""
    root = Node("#", None)
    opened = Open(root)
    at, n = 0, len(page)
    while at < n:
        node = opened.stack[-1]
        start = page.find("<", at)
        if start < 0:
            node.parts.append(page[at:])
            break
        if start > at:
            node.parts.append(page[at:start])
        m = TAG.match(page, start) or SHORT_TAG.match(page, start)
        if not m:
            if re.match(r"<[a-zA-Z/!?]", page[start : start + 2]):
                break  # a tag that the page's end cuts off
            node.parts.append("<")
            at = start + 1
            continue
        if m[0] == "<!--":
            end = page.find("-->", start + 2)
            at = n if end < 0 else end + 3
            continue
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            opened.end((tag,), 0 if tag in BLOCKS else opened.blocks[-1])
            continue
        if tag in CLOSES_P:
            opened.end(("p",), opened.blocks[-1])
        elif tag in ENDS:
            opened.end(ENDS[tag][0], opened.last(ENDS[tag][1]))
        node = opened.stack[-1]
        child = Node(tag, node, boilerplate(tag, m[3], bool(opened.at.get("article"))))
        node.parts.append(child)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            child.parts.append(page[at : end.start() if end else n])
            at = n if not end else page.find(">", end.start()) + 1 or n
        elif tag not in VOID and not m[3].rstrip().endswith("/") or tag in BLOCKS - VOID:
            opened.push(child)
    return root


def measured(root: Node) -> list[Node]:
    """Drop what holds no article text by definition, count characters and tags bottom-up; the nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.parts = [x for x in node.parts if isinstance(x, str) or x.drop != "!"]
        order.append(node)
        stack.extend(reversed(node.nodes()))
    for node in reversed(order):
        inner = node.nodes()
        node.chars = sum(len("".join(x.split())) for x in node.parts if isinstance(x, str)) + sum(x.chars for x in inner)
        node.tags = len(inner) + sum(x.tags for x in inner)
        link = node.tag == "a"
        node.link_chars = node.chars if link else sum(x.link_chars for x in inner)
        node.link_tags = node.tags + 1 if link else sum(x.link_tags for x in inner)
    return order


def composite(node: Node, link_share: float) -> float:
    """Characters per tag times the log of their ratios to linked characters and link tags; its base grows with links, by the page's share of them."""
    c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
    base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + link_share * c + math.e)
    return c / t * max(math.log(max(c / lc * t / lt, 1.0)), 0.0) / math.log(base) if c and base > 1 else float(c) / t


def weigh(order: list[Node]) -> None:
    """Densities under the names that count, sums over children (a leaf: its own), and the greatest sum at or below each node.

    What only wraps another node has no sum. What several names cover is weighed down once, by the strongest.
    """
    root = order[0]
    share = root.link_chars / max(root.chars, 1)
    for node in order:
        node.weight = min(node.parent.weight if node.parent else 1.0, TALKED if node.drop in TALK else NAMED if node.drop else 1.0)
        node.density = node.weight * composite(node, share)
    for node in reversed(order):
        inner = node.nodes()
        node.total = 0.0 if len(inner) == 1 and inner[0].chars == node.chars else sum(x.density for x in inner) if inner else node.density
        node.peak = node
        for x in inner:
            if x.peak.total > node.peak.total:
                node.peak = x.peak


def upwards(node: Node) -> list[Node]:
    path = [node]
    while path[-1].parent:
        path.append(path[-1].parent)
    return path


def chosen(root: Node) -> tuple[list[Node], float]:
    """Subtrees that hold the main text, in page order, and the threshold of the body path."""
    best = root.peak
    path = upwards(best)
    threshold = min(x.density for x in path if x is best or x.tag not in ("#", "html"))
    whole = max((x.density for x in path if x.tag in ("body", "#")), default=0.0)
    taken = {id(best)}
    taken.update(id(x) for x in path if x.tag == "article" and x.density >= whole)
    for x in path[:-1]:
        for y in x.parent.parts[: next(i for i, y in enumerate(x.parent.parts) if y is x)]:
            if not isinstance(y, str) and y.tag == "h1" and not y.drop:
                taken.add(id(y))
    stack = [root]
    while stack:
        node = stack.pop()
        if node.density >= threshold or node.tag in ("#", "html") and node in path:
            if node.density >= threshold and node.chars:
                taken.add(id(node.peak))
            stack.extend(node.nodes())
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if id(node) in taken:
            out.append(node)
        else:
            stack.extend(reversed(node.nodes()))
    return out, threshold


def overlooked(root: Node) -> list[Node]:
    """The outermost nodes named as talk of readers, where next to nothing else is on the page."""
    out, stack = [], [root]
    while stack:
        for x in stack.pop().nodes():
            (out if x.drop in TALK else stack).append(x)
    talk = sum(x.chars - x.link_chars for x in out)
    return out if 10 * (root.chars - root.link_chars - talk) < talk else []


def choose(root: Node) -> list[Node]:
    """The subtrees of the main text, without the named parts in them that count as boilerplate."""
    order = measured(root)
    while talk := overlooked(root):
        for x in talk:
            x.drop = ""
    while True:
        weigh(order)
        found, threshold = chosen(root)
        refuted = [x for x in upwards(root.peak) if x.drop]
        gone: dict[str, list[Node]] = {}
        if not refuted:
            kept, stack = 0, list(found)
            while stack:
                node = stack.pop()
                kept += sum(len("".join(x.split())) for x in node.parts if isinstance(x, str))
                for x in node.nodes():
                    if x.drop and x.density < threshold:
                        gone.setdefault(x.drop, []).append(x)
                    else:
                        stack.append(x)
            held = {word: sum(x.chars - x.link_chars for x in nodes) for word, nodes in gone.items() if word not in TALK}
            word = max(held, key=lambda w: held[w], default="")
            if word and 2 * held[word] > kept + sum(held.values()):
                refuted = gone[word]
        if not refuted:
            break
        for x in refuted:
            x.drop = ""
    for nodes in gone.values():
        for x in nodes:
            x.parts = []
    return found


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of the blocks below nodes, in page order, white space made single."""
    out, run = [], []

    def flush() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    stack: list[Node | str | None] = []
    for node in reversed(nodes):
        stack += [None, node] if len(nodes) > 1 else [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(entities.unescape(x))  # each text on its own: markup inside a reference parts it
        elif x.tag == "br":
            run.append(" ")
        else:
            if x.tag in BLOCKS:
                flush()
                stack.append(None)
            stack.extend(reversed(x.parts))
    flush()
    return out


def main_text(page: str) -> str:
    return "\n\n".join(blocks(choose(parse(page))))


def extract(df: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Add the main text of each whole page; one pass over the rows, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, html):
            names = [c for c in batch.schema.names if c != text]
            found = pa.array([main_text(x) for x in texts(batch, html)], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], found], [*names, text])

    return df.mapInArrow(run, T.StructType([*[f for f in df.schema.fields if f.name != text], T.StructField(text, T.StringType())]))
