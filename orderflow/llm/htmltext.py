"""Main text of web pages by template deduction from equivalence classes of tokens.

Pages of one host are compared in groups.  A token is a tag or a word together with the path of
elements it stands in; its occurrence vector says how often it occurs on each page.  Tokens
with the same vector form an equivalence class.  Classes that are large and frequent enough, in
the same order on every page and not crossing each other are nested into the template.  What
lies between neighbouring template tokens is a slot.

A word's role is told by its class and its place.  The words of a block of text that nearly all
pages have alike are template tokens; a slot that holds nothing else is furniture, labelled or not,
and so are such blocks at the two ends of the article, and a last line that all pages begin alike.
Between varying blocks a repeated line is the article's own, like a shared heading, and stays.
Elements and labels say which slots cannot hold the article (menus, forms, comments) or must
(article, main); where they say nothing, slots go by how much of them varies.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow.llm.common import free_name, small_batches, without
from orderflow.session import Stage

RAW = "script|style|noscript|template|svg|iframe|textarea|title|object|canvas|math"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][-:\w]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?][^>]*>|([^<]+|<)",
    re.S | re.I,
)
LABEL = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr img".split()
)
# How tokens of tags are written; those of inline elements stand inside a slot.
BLOCK_TAGS = frozenset(["<", "</", "<>"])
# An open element of the left is closed by a start tag of the right.
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
ASIDE = frozenset("nav footer aside form head button select menu dialog".split())
ASIDE_LABEL = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|banner|side-?bar|menu|nav\w*|breadcrumbs?|cookies?|consent|notices?|alert|pop-?up|modal"
    r"|newsletter|subscri\w*|promo\w*|sponsor\w*|shar(?:e|ing)|social|related|recommend\w*|comments?|repl(?:y|ies)|disqus"
    r"|widget|toolbar|login|sign-?up|search|navigation|complementary|contentinfo|site-(?:header|footer))(?:$|[-_\s])",
    re.I,
)
EDGE_LABEL = re.compile(r"(?:^|[-_\s])(?:header|footer|masthead)(?:$|[-_\s])", re.I)
MAIN_LABEL = re.compile(r"(?:^|[-_\s])(?:main|articlebody|article-?(?:body|content|text)|post-?(?:body|content)|entry-content)(?:$|[-_\s])", re.I)


# Class names that tell a page's state, such as has-sidebar or nav-open, name no element's role.
STATE = re.compile(r"(?:has|with|without|no|not|is|js)-.*|.*-(?:open|opened|closed|active|enabled|ready)", re.I)
COMMENT = frozenset("comment comments reply replies".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements that hold text of their own beside other blocks: the container of that text.
BOX = frozenset("div section article main td body html".split())


@dataclass(eq=False, slots=True)
class Element:
    """An open element; ``block`` is the path of the block around it, ``box`` of that block's container."""

    name: str
    path: str
    block: str
    box: str
    heading: bool
    aside: bool
    main: bool
    link: bool
    start: tuple[str, str]
    end: tuple[str, str]


ROOT = Element("", "", "", "", False, False, False, False, ("", "<"), ("", "</"))


@lru_cache(2048)
def _roles(labels: str) -> tuple[bool, bool, bool, bool]:
    """Whether the labels name furniture, a page's edge, the article, or a reader's comment."""
    names = labels.split()
    told = " ".join(n for n in names if not STATE.fullmatch(n))
    return bool(ASIDE_LABEL.search(told)), bool(EDGE_LABEL.search(told)), bool(MAIN_LABEL.search(told)), not COMMENT.isdisjoint(names)


def _opened(name: str, labels: str, above: Element) -> Element:
    path = f"{above.path}>{name}"
    if name in ("html", "body"):
        # What a page is called says nothing about the parts of it.
        return Element(name, path, path, path, False, False, False, False, (path, "<"), (path, "</"))
    furniture, edge, article, comment = _roles(labels) if labels else (False, False, False, False)
    main = above.main or article or name in ("article", "main")
    if name == "main":
        aside = False
    elif name == "article":
        aside = above.aside or comment
    else:
        aside = above.aside or furniture or name in ASIDE or (not main and (edge or name == "header"))
    path += f".{labels}" if labels else ""
    if name in INLINE and (aside, main) == (above.aside, above.main):
        block, box, heading = above.block, above.box, above.heading
    else:
        block, box, heading = path, path if name in BOX else above.path, name in HEADING
    mark = "~" if name in INLINE else ""
    return Element(name, path, block, box, heading, aside, main, above.link or name == "a", (path, "<" + mark), (path, "</" + mark))


@dataclass(slots=True)
class Page:
    """Tokens in page order: their names, and for words their text token; text tokens apart."""

    names: list[tuple]
    texts: list[tuple[int, int, Element, str]]  # place of the first word, block, element, text
    units: list[tuple[int, int]]  # of each text: its block if a line break ended none, and its words
    blocks: dict[int, tuple[str, str]]  # path and text of each such block


def parse(html: str, known: dict[tuple, Element] | None = None) -> Page:
    """The page's tokens; ``known`` keeps elements that pages of a group have in common."""
    known = {} if known is None else known
    stack, names, texts, units, block, unit = [ROOT], [], [], [], 0, 0
    parts: dict[int, list[str]] = {}
    for match in TOKEN.finditer(html):
        raw, closing, name, attributes, text = match.groups()
        if text is not None:
            text = entities.unescape(text) if "&" in text else text
            here = stack[-1]
            texts.append((len(names), block, here, text))
            words = text.split()
            units.append((unit, len(words)))
            if words:
                names.extend([(here.path, w) for w in words])
                parts.setdefault(unit, [here.block]).append(text)
        elif name:
            name = name.lower()
            if name not in INLINE:
                block += 1
                unit += name != "br"
            if closing:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        names.append(stack[i].end)
                        del stack[i:]
                        break
            else:
                if name not in INLINE and name != "br":
                    _close_implied(name, stack)
                labels = " ".join(a or b or c for _, a, b, c in LABEL.findall(attributes)) if attributes.strip() else ""
                key = (stack[-1], name, labels)
                opened = known.get(key)
                if opened is None:
                    opened = known[key] = _opened(*key[1:], key[0])
                names.append(opened.start)
                if name not in VOID and not attributes.rstrip().endswith("/"):
                    stack.append(opened)
        elif raw:
            names.append((f"{stack[-1].path}>{raw.lower()}", "<>"))
    blocks = {unit: (path, "".join(rest).strip()) for unit, (path, *rest) in parts.items()}
    return Page(names, texts, units, blocks)


def _close_implied(name: str, stack: list[Element]) -> None:
    """A block ends an open paragraph; items, cells and the like end their neighbours."""
    for i in range(len(stack) - 1, 0, -1):
        opened = stack[i].name
        if opened == "p" or name in CLOSED_BY.get(opened, ()):
            del stack[i:]
            return
        if opened not in INLINE:
            return


def _in_order(sequences: list[list[int]]) -> list[int]:
    """The members that stand in one order on every page, by the longest run of the first's order."""
    kept = sequences[0]
    for places in sequences[1:]:
        where = {m: i for i, m in enumerate(places)}
        tails: list[int] = []
        chain: list[tuple[int, int]] = []
        last: dict[int, int] = {}
        for m in kept:
            at = bisect_left(tails, where[m])
            chain.append((m, last[at - 1] if at else -1))
            last[at] = len(chain) - 1
            tails[at : at + 1] = [where[m]]
        out, i = [], last[len(tails) - 1] if tails else -1
        while i >= 0:
            out.append(chain[i][0])
            i = chain[i][1]
        kept = out[::-1]
    return kept


def template(pages: list[Page], least: int = 2) -> dict[tuple, int]:
    """The tokens of the template with their nesting depth: classes that are valid, outer first.

    A class is large (two tokens or more) and frequent (half of the pages, two at least).  One
    that occurs once a page keeps the tokens in a common order; one that repeats must go round
    its tokens in turn on every page, within one slot of those found before it.
    """
    frequent = max(least, -(-len(pages) // 2))
    seen: Counter[tuple] = Counter()
    for page in pages:
        seen.update(set(page.names))
    # The places of all other tokens are never asked for.
    often = {name for name, n in seen.items() if n >= frequent}
    places: list[dict[tuple, list[int]]] = []
    vectors: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    for i, page in enumerate(pages):
        places.append(where := defaultdict(list))
        for place, name in enumerate(page.names):
            if name in often:
                where[name].append(place)
        for name, at in where.items():
            vectors[name].append((i, len(at)))
    classes = defaultdict(list)
    for name, vector in vectors.items():
        classes[tuple(vector)].append(name)
    found: dict[tuple, int] = {}
    outer: list[list[tuple[int, tuple]]] = [[] for _ in pages]
    ranked = sorted(classes.items(), key=lambda c: (sum(n for _, n in c[0]) / len(c[0]), -len(c[0]), -len(c[1])))
    for vector, members in ranked:
        if len(members) < 2:
            continue
        rounds = [[name for _, name in _placed(places[i], members)] for i, _ in vector]
        once = all(n == 1 for _, n in vector)
        if once:
            number = {m: k for k, m in enumerate(rounds[0])}
            order = [rounds[0][k] for k in _in_order([[number[m] for m in r] for r in rounds])]
            if len(order) < 2:
                continue
        else:
            size = len(members)
            order = rounds[0][:size]
            if any(r != order * (len(r) // size) for r in rounds):
                continue
        # Nested: from its first to its last token in a round, no outer token of another slot.
        if found and not _nested(places, [i for i, _ in vector], order, outer, once):
            continue
        depth = max(found.values(), default=0) + 1
        found.update((m, depth) for m in order)
        for i, _ in vector:
            outer[i] = sorted(outer[i] + _placed(places[i], order))
    return found


def _placed(where: dict[tuple, list[int]], members: list[tuple]) -> list[tuple[int, tuple]]:
    """The members' places on a page, in page order."""
    return sorted((place, m) for m in members for place in where[m])


def _nested(
    places: list[dict[tuple, list[int]]], where: list[int], order: list[tuple], outer: list[list[tuple[int, tuple]]], once: bool
) -> bool:
    """Whether each round of the class lies within one slot of ``outer``, on every page."""
    slots = set()
    for i in where:
        start = None
        for place, name in _placed(places[i], order):
            at = bisect_left(outer[i], (place,))
            before = outer[i][at - 1][1] if at else None
            if name == order[0]:
                start = before
            elif start != before:
                return False
        slots.add(start)
        if once and len(slots) > 1:
            return False
    return True


@dataclass(slots=True)
class Slot:
    """What the pages of a group have between two neighbouring template tokens; words of template blocks apart."""

    element: Element
    words: int = 0
    linked: int = 0

    def rank(self, richest: int, box: str) -> int:
        """2: in the article; 1: varies and is rich in words that are not links, or stands in the richest slot's box."""
        if self.element.aside or not self.words:
            return 0
        if self.element.main:
            return 2
        if self.linked * 2 > self.words:
            return 0
        beside = bool(box) and (self.element.box == box or self.element.box.startswith(box + ">"))
        return int(beside or self.words - self.linked >= max(1, richest // 10))


@dataclass(slots=True)
class Text:
    """A text token of a page: where it stands, and whether its block is of the template."""

    slot: Slot
    block: int
    unit: int
    text: str
    known: bool


def extract(group: list[str]) -> list[str]:
    """The main text of each page of a group of pages of one host.

    A slot is named by the template's block tag before it and the block elements around the text.
    A page keeps its slots of the highest rank, whole but for template blocks at their ends.
    """
    elements: dict[tuple, Element] = {}
    parsed = {h: parse(h, elements) for h in dict.fromkeys(group)}
    distinct = list({tuple(p.names): p for p in parsed.values()}.values())
    fixed = template(distinct) if len(distinct) > 2 else {}
    standing = _standing(distinct)
    slots: dict[tuple, Slot] = {}
    slotted: dict[str, list[Text]] = {}
    for html, page in parsed.items():
        marks = [i for i, name in enumerate(page.names) if name[1] in BLOCK_TAGS and name in fixed]
        rows = slotted[html] = []
        for (place, block, element, text), (unit, n) in zip(page.texts, page.units):
            at = bisect_left(marks, place)
            slot = slots.setdefault((page.names[marks[at - 1]] if at else None, element.block), Slot(element))
            known = bool(standing) and page.blocks.get(unit) in standing
            if not known:
                slot.words += n
                slot.linked += n * element.link
            if n or block:
                rows.append(Text(slot, block, unit, text, known))
    open_ = [s for s in slots.values() if not (s.element.aside or s.element.heading)]
    top = max(open_, key=lambda s: s.words - s.linked, default=None)
    richest = top.words - top.linked if top else 0
    # The whole page is no box.
    box = top.element.box if richest and not re.fullmatch(r"(?:>html|>body)*", top.element.box) else ""
    kept = {html: _chosen(rows, richest, box) for html, rows in slotted.items()}
    closing = _closing(list({tuple(_words(rows)): rows for rows in kept.values() if rows}.values()))
    texts = {html: _joined(_without_last(rows, closing)) for html, rows in kept.items()}
    return [texts[html] for html in group]


def _standing(pages: list[Page], least: int = 3) -> frozenset[tuple[str, str]]:
    """Blocks of text that are template tokens: alike on nine of ten different pages, three at least.

    The words of such a block occur on the same pages, once for each time the block does and in
    its order: told apart from equal words elsewhere, they are a valid class.
    """
    if len(pages) < least:
        return frozenset()
    frequent = max(least, -(-len(pages) * 9 // 10))
    seen = Counter(block for page in pages for block in set(page.blocks.values()))
    return frozenset(block for block, n in seen.items() if n >= frequent)


def _chosen(rows: list[Text], richest: int, box: str) -> list[Text]:
    """The texts of the page's best slots; an article that only repeats what all pages have is kept."""
    ranks = [row.slot.rank(richest, box) for row in rows]
    # A heading belongs to what follows it in its own box, whether it varies or not.
    after, within = 0, ""
    for i in range(len(rows) - 1, -1, -1):
        element = rows[i].slot.element
        if not rows[i].text.strip():
            continue
        if element.heading and not element.aside:
            own = 2 if element.main else after if within == element.box or within.startswith(element.box + ">") else 0
            ranks[i] = own
        else:
            after, within = ranks[i], element.box
    best = max((r for r, row in zip(ranks, rows) if row.text.strip()), default=0)
    varies = any(r == best and not row.known and row.text.strip() for r, row in zip(ranks, rows))
    if not best or not varies:
        return [row for row in rows if row.slot.element.main and not row.slot.element.aside]
    return _trimmed([row for r, row in zip(ranks, rows) if r == best])


def _trimmed(rows: list[Text]) -> list[Text]:
    """The texts without template blocks at the beginning, behind headings, and at the end."""
    drop: set[int] = set()
    for row in rows:
        if row.known and not row.slot.element.heading:
            drop.add(row.unit)
        elif row.text.strip() and not row.slot.element.heading:
            break
    for row in reversed(rows):
        if row.known:
            drop.add(row.unit)
        elif row.text.strip():
            break
    return [row for row in rows if row.unit not in drop]


def _words(rows: list[Text]) -> list[str]:
    return [row.text for row in rows]


def _last(rows: list[Text]) -> tuple[int, tuple[str, ...]] | None:
    """The last block with words, if there is another before it, and how it begins."""
    unit = next((row.unit for row in reversed(rows) if row.text.strip()), None)
    if unit is None or not any(row.text.strip() for row in rows if row.unit != unit):
        return None
    mine = [row for row in rows if row.unit == unit]
    words = "".join(row.text for row in mine).split()
    return (unit, (mine[0].slot.element.block, *words[:2])) if len(words) > 2 else None


def _closing(pages: list[list[Text]], least: int = 8) -> tuple[str, ...] | None:
    """How the last block begins on nine of ten different pages, eight at least: template tokens before a slot."""
    if len(pages) < least:
        return None
    seen = Counter(last[1] for last in map(_last, pages) if last)
    start, n = max(seen.items(), key=lambda s: s[1], default=(None, 0))
    return start if n >= max(least, -(-len(pages) * 9 // 10)) else None


def _without_last(rows: list[Text], closing: tuple[str, ...] | None) -> list[Text]:
    last = _last(rows) if closing else None
    return [row for row in rows if row.unit != last[0]] if last and last[1] == closing else rows


def _joined(rows: list[Text]) -> str:
    blocks: dict[int, list[str]] = {}
    for row in rows:
        blocks.setdefault(row.block, []).append(row.text)
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return " ".join(b for b in joined if b)


def main_text(
    pages: DataFrame, html: str = "html", url: str = "url", column: str = "text", per_group: int = 64, most_bytes: int = 8 << 20
) -> DataFrame:
    """``pages`` with the main text in place of the html; empty where there is none.

    Pages of one host are dealt into groups of about ``per_group`` pages and ``most_bytes`` by a
    hash of the whole row, so a host of any size makes many small groups with a template each.  A
    group with fewer than three different pages has no template and goes by elements alone.
    NULL html is empty, a NULL url is a host of its own; equal pages of a group are extracted
    once and count once in the template.  Html of any length is read whole; an empty table gives
    no rows.  A column named like the new one is replaced, all others are handed through.
    """
    spark = pages.sparkSession
    small_batches(spark)
    base = without(pages, *({column} - {html}))
    name, groups, group = (free_name(pages, n) for n in ("_host", "_groups", "_group"))
    host = F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][-+.\w]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    hosts = (
        base.groupBy(host.alias(name))
        .agg(F.count("*").alias("n"), F.sum(F.coalesce(F.length(html), F.lit(0))).alias("size"))
        .select(name, F.greatest(F.ceil(F.col("n") / per_group), F.ceil(F.col("size") / most_bytes)).alias(groups))
        .where(F.col(groups) > 1)
    )
    hosts = Stage(spark).put("hosts", hosts)
    # Only hosts with more than one group are in the table; past this size both sides are shuffled.
    hosts = F.broadcast(hosts) if hosts.count() <= 200_000 else hosts
    keep = [c for c in base.columns if c != html]
    hashed = F.xxhash64(*[F.col(f"`{f.name}`") for f in base.schema if not isinstance(f.dataType, T.MapType)])
    keyed = (
        base.withColumn(name, host)
        .join(hosts, name, "left")
        .withColumn(group, F.pmod(hashed, F.coalesce(groups, F.lit(1))))
        .drop(groups)
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[keep].copy()
        out[column] = extract([h if isinstance(h, str) else "" for h in rows[html]])
        return out

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name != html), f"{column} string"])
    return keyed.groupBy(name, group).applyInPandas(run, schema)
