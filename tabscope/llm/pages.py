"""HTML extraction with wrappers inferred for each host as union-free regular expressions.

A page is a stream of tags and texts, nested into elements.  Pages of one host are
aligned one after the other into a wrapper, a regular expression without alternatives:
elements that repeat become repeated groups, elements that some pages lack become
optional, and texts that differ become slots.

The wrapper tells the article from the frame, once for the host.  Fixed texts and links
weigh nothing; from the root on, the element that holds most of the slots' characters is
entered, and what lies beside it is frame, but for headings and paragraphs.  It ends where
the slots are spread over several elements or a repeated group: that is the article, and
all in it is kept but divisions whose text the host repeats on every page.  Names and classes only
weigh in: those usual for frames count for nothing, those usual for articles count
``FAVOUR`` times, and a part of the article with a frame's name goes.

Each page is then matched against its host's wrapper.  A page in which the wrapper's
article isn't found, or whose host has none, is judged by the same rules alone.

A wrapper is inferred from up to ``SAMPLE_PAGES`` pages of its host of up to
``SAMPLE_CHARS`` characters, one for each part of the pages' hashes; that is the
documented bound of the fit.  All pages are extracted whole.

Blocks are the texts between block-level tags; a line break within one counts as white
space.  Null or empty pages have no text; a null address counts as a host of its own.  A
tag without an end is text, unless it is what a page breaks off in.  Elements nested more
than ``DEPTH`` deep count as lying side by side, so that pages of any size and depth take
time in proportion to their length; of equal parts the first one is the article.  Rows are
independent otherwise, repeated ones give repeated results, an empty table gives an empty
one.  Other columns pass through, but for one named ``main_text``, which the result
replaces.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabscope.llm.shared import Scratch, prepare, unused, without

#: Pages of each host from which its wrapper is inferred, at most.
SAMPLE_PAGES = 16
#: Size up to which all hosts' wrappers go to every task.
BROADCAST_BYTES = 16_000_000
#: Labels in a group of siblings that may repeat as a whole.
LONGEST_GROUP = 3
#: Pages that must agree on a text before it counts as the host's own.
FIXED_PAGES = 6
#: Characters of a sampled page, at most.
SAMPLE_CHARS = 300_000
#: Elements within one another that are told apart.
DEPTH = 120
#: Share of a level's slots that an element must hold to be entered, and what a usual name counts.
ENTERED = 0.6
FAVOUR = 3

# A quoted value ends before the next tag; what is taken is never given back.
ATTRIBUTES = r"""(?>"[^"<]*"|'[^'<]*'|[^>])*+"""
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<raw>script|style|noscript|template|textarea|svg|iframe)\b"""
    + ATTRIBUTES
    + r""">.*?(?:</(?P=raw)\s*>|\Z)"""
    r"""|</(?P<end>[a-z][^\s/>]*)[^>]*(?:>|\Z)"""
    r"""|<(?P<tag>[a-z][^\s/>]*)(?P<attributes>"""
    + ATTRIBUTES
    + r""")>"""
    r"""|(?P<text>[^<]+|<)""",
    re.I | re.S,
)
OPENS = re.compile("<[a-z]", re.I)
MARK = re.compile(r"""\b(class|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that a start tag ends, up to the elements that bound the search.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

FRAME_TAGS = frozenset("head nav footer aside form button select dialog menu title".split())
FRAME_WORDS = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
    "footer header login masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo related "
    "reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
ARTICLE_TAGS = frozenset(["article", "main"])
ARTICLE_WORDS = frozenset("article content entry main post story".split())
#: Elements without a meaning of their own.
DIVISIONS = frozenset("div section center".split())
#: What belongs to an article even beside its main part.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())


@dataclass
class Node:
    """An element (``label`` is its name and marks) or a text (label ``#``)."""

    label: str
    parts: list[str] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)

    @property
    def text(self) -> str:
        return "".join(self.parts)


def label_of(tag: str, attributes: str) -> str:
    """Name and class words; digits, which tell pages apart, don't count."""
    marks = set()
    for _, *values in MARK.findall(attributes) if attributes else ():
        marks.update(re.findall(r"[a-z]+", "".join(values).lower()))
    return " ".join([tag, *sorted(marks)])


def tokens(html: str) -> Iterator[re.Match | str]:
    """The page's tokens; once a tag has no end, no later one has, and the rest is one text."""
    at = 0
    while at < len(html):
        m = TOKEN.match(html, at)
        if m["text"] == "<" and OPENS.match(html, at):
            if "<" in html[at + 1 :]:
                yield html[at:]
            return
        yield m
        at = m.end()


def parsed(html: str) -> Node:
    root = Node("root")
    open_nodes, names = [root], [""]
    held = {"": 1}  # how often a name is open

    def close_to(depth: int) -> None:
        for name in names[depth:]:
            held[name] -= 1
        del open_nodes[depth:], names[depth:]

    for m in tokens(html):
        if text := m if isinstance(m, str) else m["text"]:
            last = open_nodes[-1].children
            if last and last[-1].label == "#":
                last[-1].parts.append(text)
            else:
                last.append(Node("#", [text]))
        elif tag := m["tag"]:
            tag = tag.lower()
            ends, bounds = CLOSES.get(tag, (set(), set()))
            if tag in BLOCKS:
                ends, bounds = ends | {"p"}, bounds | (BLOCKS - {"p"} - ends)
            for depth in range(len(names) - 1, 0, -1) if any(held.get(e) for e in ends) else ():
                if names[depth] in ends:
                    close_to(depth)
                    break
                if names[depth] in bounds:
                    break
            node = Node(label_of(tag, m["attributes"]))
            open_nodes[-1].children.append(node)
            if tag not in VOID and not m["attributes"].endswith("/") and len(names) < DEPTH:
                open_nodes.append(node)
                names.append(tag)
                held[tag] = held.get(tag, 0) + 1
        elif end := m["end"]:
            end = end.lower()
            if held.get(end):
                close_to(len(names) - 1 - names[::-1].index(end))
    return root


@dataclass
class Item:
    """A part of a wrapper: an element or text that may be optional or repeat."""

    label: str
    optional: bool = False
    repeats: bool = False
    fixed: str | None = None  # the text that all pages share; None is a slot
    pages: int = 1
    chars: int = 0
    linked: int = 0
    items: list[Item] = field(default_factory=list)

    def regex(self) -> str:
        name = self.label.split(" ")[0]
        inner = "".join(i.regex() for i in self.items)
        body = (re.escape(self.fixed) if self.fixed is not None else "#") if self.label == "#" else f"<{name}>{inner}</{name}>"
        mark = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[self.optional, self.repeats]
        return f"({body}){mark}" if mark else body


def lifted(nodes: list[Node], linked: bool = False) -> list[Item]:
    """Siblings as wrapper items, repeated ones folded."""
    items = []
    for n in nodes:
        if n.label == "#":
            if text := " ".join(n.text.split()):
                items.append(Item("#", fixed=text, chars=len(text), linked=len(text) * linked))
        else:
            inner = lifted(n.children, linked or n.label.split(" ")[0] == "a")
            items.append(
                Item(n.label, items=inner, chars=sum(i.chars for i in inner), linked=sum(i.linked for i in inner))
            )
    return folded(items)


def folded(items: list[Item]) -> list[Item]:
    """Runs of one to LONGEST_GROUP labels that repeat become one, as often as they come."""
    for size in range(1, LONGEST_GROUP + 1):
        out: list[Item] = []
        at = 0
        while at < len(items):
            group = items[at : at + size]
            labels = [i.label for i in group]
            own = out[-size:]
            if len(group) == size and labels != ["#"] and [i.label for i in own] == labels:
                out[-size:] = [merged(a, b, same_page=True, repeats=True) for a, b in zip(own, group, strict=True)]
                at += size
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def merged(a: Item, b: Item, same_page: bool = False, repeats: bool = False) -> Item:
    return Item(
        a.label,
        a.optional or b.optional,
        a.repeats or b.repeats or repeats,
        a.fixed if a.fixed == b.fixed else None,
        a.pages if same_page else a.pages + b.pages,
        a.chars + b.chars,
        a.linked + b.linked,
        aligned(a.items, b.items, same_page),
    )


def aligned(a: list[Item], b: list[Item], same_page: bool = False) -> list[Item]:
    """Align two sibling lists; what only one of them has turns optional."""
    matcher = SequenceMatcher(None, [i.label for i in a], [i.label for i in b], autojunk=False)
    out: list[Item] = []
    for kind, a0, a1, b0, b1 in matcher.get_opcodes():
        if kind == "equal":
            out += [merged(x, y, same_page) for x, y in zip(a[a0:a1], b[b0:b1], strict=True)]
        else:
            for item in [*a[a0:a1], *b[b0:b1]]:
                item.optional = True
                out.append(item)
    return folded(out)


def inferred(pages: list[str]) -> list[Item]:
    wrapper: list[Item] | None = None
    for html in pages:
        own = lifted(parsed(html).children)
        wrapper = own if wrapper is None else aligned(wrapper, own)
    return wrapper or []


def is_frame(label: str, in_article: bool) -> bool:
    tag, *marks = label.split(" ")
    if tag == "header":
        return not in_article
    return tag in FRAME_TAGS or (bool(FRAME_WORDS.intersection(marks)) and tag not in ARTICLE_TAGS)


def is_article(label: str) -> bool:
    tag, *marks = label.split(" ")
    return tag in ARTICLE_TAGS or (tag in BLOCKS and bool(ARTICLE_WORDS.intersection(marks)) and not FRAME_WORDS.intersection(marks))


def is_fixed(item: Item) -> bool:
    return item.label == "#" and item.fixed is not None and item.pages >= FIXED_PAGES


def weight(item: Item, in_article: bool = False) -> float:
    """Characters of slots outside links, as far as names don't speak for a frame."""
    if item.label == "#":
        return 0 if is_fixed(item) else item.chars - item.linked
    if is_frame(item.label, in_article):
        return 0
    inside = in_article or is_article(item.label)
    total = sum(weight(i, inside) for i in item.items)
    return total * FAVOUR if inside and not in_article else total


def judged(items: list[Item]) -> list[list]:
    """The wrapper as (label, verdict, children, fixed texts).

    Verdicts are "frame", "enter" (the way to the article), "article" and "prose" (beside the way, kept).
    """
    weights = [weight(i) for i in items]
    best = max(range(len(items)), key=weights.__getitem__, default=None)
    enter = (
        best is not None and items[best].label.split(" ")[0] not in PROSE | {"#"} and not items[best].repeats
        and weights[best] > 0 and weights[best] >= ENTERED * sum(weights)
    )
    if not enter:
        return kept(items)
    out = []
    for k, i in enumerate(items):
        if k == best:
            out.append([i.label, "enter", judged(i.items), []])
        elif i.label.split(" ")[0] in PROSE and weights[k] > 0:
            out.append([i.label, "prose", kept(i.items), []])
        else:
            out.append([i.label, "frame", [], []])
    return out


def kept(items: list[Item], division: bool = False) -> list[list]:
    """All of an article but frames within it and texts of its divisions that the host repeats."""
    out = []
    for i in items:
        linked = i.chars > 0 and i.linked > 0.5 * i.chars
        # a menu: links that many pages repeat, or a list of nothing but links
        menu = linked and i.pages >= FIXED_PAGES and (i.repeats or len(i.items) > 1 or i.label.split(" ")[0] in ("ul", "ol", "a"))
        if i.label != "#" and (is_frame(i.label, True) or menu):
            out.append([i.label, "frame", [], []])
        else:
            inner = kept(i.items, i.label.split(" ")[0] in DIVISIONS)
            out.append([i.label, "article", inner, [i.fixed] if division and is_fixed(i) else []])
    return out


def wrapper_of(pages: list[str]) -> str:
    items = inferred([p for p in pages if len(p) <= SAMPLE_CHARS])
    return json.dumps({"items": judged(items), "regex": "".join(i.regex() for i in items)})


def extract(html: str | None, wrapper: str | None) -> str:
    """Main text of a page."""
    page = parsed(html or "")
    items = json.loads(wrapper)["items"] if wrapper else []
    found = main_blocks(page, items) if items else None
    return "\n".join(main_blocks(page, judged(lifted(page.children))) if found is None else found)


def main_blocks(page: Node, verdicts: list[list]) -> list[str] | None:
    """Blocks of the article; None if the page has text, but not where the wrapper expects the article."""
    blocks: list[str] = []
    run: list[str] = []
    lost = [False]

    def flush() -> None:
        if text := " ".join(unescape("".join(run)).split()):
            blocks.append(text)
        run.clear()

    def walk(nodes: list[Node], items: list[list], keep: bool) -> None:
        places: dict[str, list[int]] = {}
        for k, item in enumerate(items):
            places.setdefault(item[0], []).append(k)
        at, entered = 0, not any(i[1] == "enter" for i in items)
        for n in nodes:
            # the wrapper's next item of this label; a repeated one stays in place
            own = places.get(n.label)
            verdict, inner, fixed = None, [], []
            if own:
                at = own[bisect_left(own, at) % len(own)]
                _, verdict, inner, fixed = items[at]
            inside = verdict in ("article", "prose") or (verdict is None and keep)
            if n.label == "#":
                if inside and (not fixed or " ".join(n.text.split()) not in fixed):
                    run.append(n.text)
                continue
            tag = n.label.split(" ")[0]
            block = tag in BLOCKS
            if block:
                flush()
            elif tag in VOID:
                run.append(" ")
            if verdict == "enter":
                entered = True
                walk(n.children, inner, not any(i[1] == "enter" for i in inner))
            elif inside and not (verdict is None and is_frame(n.label, True)):
                walk(n.children, inner, True)
            if block:
                flush()
        lost[0] |= not entered

    walk(page.children, verdicts, not any(i[1] == "enter" for i in verdicts))
    flush()
    return None if lost[0] else blocks


def host_of(url: str):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host`` and ``wrapper`` (JSON: verdicts and the inferred expression) of every host."""
    rows = pages.where(F.col(html).isNotNull()).select(host_of(url).alias("host"), F.col(html).alias("html"))
    drawn = rows.select("host", "html", F.xxhash64("html").alias("draw"))
    # one page for each part of the hash, chosen before the shuffle as after it
    part = F.pmod("draw", F.lit(SAMPLE_PAGES)).alias("part")
    sample = drawn.groupBy("host", part).agg(F.min_by("html", F.shiftright("draw", 8)).alias("html"))

    def infer(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [batch["host"].iloc[0]], "wrapper": [wrapper_of(sorted(set(batch["html"])))]})

    return sample.groupBy("host").applyInPandas(infer, "host string, wrapper string")


def main_texts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with ``main_text``."""
    prepare(pages.sparkSession)

    @F.pandas_udf("string")
    def main_text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for htmls, own in batches:
            yield pd.Series([extract(h, w) for h, w in zip(htmls, own, strict=True)], dtype=object)

    host, own = unused(pages, "page_host"), unused(pages, "page_wrapper")
    scratch = Scratch(pages.sparkSession, "pages")
    known = wrappers(pages, url, html).select(F.col("host").alias(host), F.col("wrapper").alias(own))
    known = scratch.keep(known, "wrappers")
    size = known.agg(F.sum(F.octet_length(own))).first()[0] or 0
    if size <= BROADCAST_BYTES:  # else pages and wrappers meet by host, skewed hosts split
        known = F.broadcast(known)
    rows = pages.withColumn(host, host_of(url)).join(known, host, "left")
    return rows.select(*without(pages, "main_text"), main_text(F.col(html), F.col(own)).alias("main_text"))
