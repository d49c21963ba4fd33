"""Main text of web pages by equivalence-class template deduction.

A page is read as tokens: each element by the path of tags, classes and ids down
to it, and each block of text by its path and words. For every host, tokens with
the same occurrence vector over its pages (told by a digest that adds up in any
order, so no host's pages meet in one task) form an equivalence class. A class is
valid if
- it has at least two tokens, each on at least half of the host's pages,
- its tokens come in one order, over and over where they repeat,
- its occurrences lie in one slot of the class that encloses it,
and the last two hold on nine tenths of the class's pages, which have at least
two, and half of the host's, distinct articles. Pages that consist mostly of wording which
other pages share, in slots where wording differs, are copies of one article.

The elements of valid classes bound the template's slots: a block of text is in
the slot of the lowest one around it. Slots whose own text is links over the whole
host are menus, the texts of valid once-a-page classes are fixed wording, and
the remaining slots hold the main text. Where the template is firm (the class is on nine
tenths of the host's pages, which have five distinct articles or more) menus, and elements that hold nothing but fixed wording, go wherever they stand. Labels then
choose among the slots that remain: what an author marks as no part of the text (nav, footer, a class like "sidebar") goes, and
the marked main part (article, main) is the text if it holds half of what remains; a template that isn't firm doesn't cut into it. Hosts with one page have no template and go by labels alone.

Reading a page takes time and memory in proportion to its length, however deep it nests and whatever it leaves open.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweld.llm.common import checkpointed, free_name

#: Elements without an end tag, elements whose content is not text (the first take in all up to their end tag, and the
#: rest of a page that has none), elements that bound a block. Fixed by the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
EMBEDDED = frozenset("noscript template svg math iframe object select canvas audio video".split())
END_TAGS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW | EMBEDDED}
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What a label says of a slot.
MAIN_TAGS, MAIN_WORDS = frozenset(("article", "main")), frozenset("article articlebody main maincontent".split())
SKIP_TAGS = EMBEDDED | frozenset("nav footer aside form menu dialog button head fieldset search".split())
SKIP_WORDS = frozenset(
    "ad ads adv advert advertisement advertising adbox sponsor sponsored promo promotion banner breadcrumb breadcrumbs "
    "comment comments commentlist disqus replies respond consent cookie cookies gdpr footer copyright form login signup "
    "masthead menu modal nav navbar navigation navigationmenu newsletter notice notices alert popup overlay pager "
    "pagination related recommended recommendations search share sharing sidebar social subscribe subscription tags "
    "toolbar topbar widget widgets contentinfo complementary".split()
)
HEADER_WORDS = frozenset("header siteheader pageheader".split())
#: Words by which a class name only says what a part has beside it, or how it stands.
ABOUT = frozenset("has have with without no not is open closed on off enabled disabled hidden free".split())
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
QUOTES = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[a-zA-Z]+")
NUMBER = re.compile(r"\d+")
#: Character references with more digits than any character has.
LONG_ZEROS, LONG_REFERENCE = re.compile(r"&#0{8,}"), re.compile(r"&#[0-9]{9,};?")

#: A token of a page: how often it stands there, and the element a text is in (0 for none, and for elements).
TOKENS = "host string, page long, token long, n long, parent long, text boolean"
#: A page's elements and texts in order: the index of the element around each, or -1, a text's code points, or -1, and those in links.
SEQUENCE = "host string, page long, tokens array<long>, around array<int>, chars array<int>, links array<int>, flags array<int>"
#: What a page tells of a class (kind 0: order, nesting and article) or of a slot (kind 1: the slot around it and its own text).
FACTS = "host string, kind int, id long, shape long, article long, chars long, link_chars long, kept boolean"
MEMBER = "struct<token: long, text: boolean, parent: long, n: long, class: long, firm: boolean>"
MAIN, SKIP, TOP = 1, 2, 4
#: Distinct articles of a host from which on its template may cut into a part that is marked as the main one.
FIRM_ARTICLES = 5
#: Bytes of templates that are sent to every executor rather than joined by a shuffle of whole pages.
SENT_BYTES = 32 << 20


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    token: int
    skip: bool = False
    main: bool = False
    parent: Node | None = None
    slot: int = 0


@dataclass(slots=True)
class Block:
    node: Node | None
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0

    def text(self) -> str:
        whole = "".join(self.parts)
        if "&#" in whole:
            whole = LONG_REFERENCE.sub("\ufffd", LONG_ZEROS.sub("&#0", whole))
        return " ".join(html.unescape(whole).split())


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _node(parent: Node | None, tag: str, attrs: str) -> Node:
    # ids often number the page's items, classes name its parts
    names = [NUMBER.sub("", b or c or d) if k.lower() == "id" else b or c or d for k, b, c, d in ATTRIBUTE.findall(attrs)] if attrs else []
    # the path down to an element is told by its parent's token and its own names
    token = _hash(f"{parent.token if parent else ''}/{tag}{''.join('.' + x for x in names)}")
    whole, pieces = set(), set()
    for name in (x.lower() for n in names for x in n.split()):
        own = WORDS.findall(name)
        whole.add("".join(own))
        if not ABOUT.intersection(own):
            pieces.update(own, ("".join(own),))
    is_main = tag in MAIN_TAGS or bool(pieces & MAIN_WORDS)
    main = bool(parent and parent.main) or is_main
    header = (tag == "header" or bool(pieces & HEADER_WORDS)) and not main
    # a main part is only skipped by a name that is such a word as a whole
    named = tag not in ("html", "body") and bool((whole if is_main else pieces) & SKIP_WORDS)
    skip = bool(parent and parent.skip) or tag in SKIP_TAGS or header or named
    return Node(tag, token, skip, main, parent)


class Markup:
    """Goes through a page's markup from left to right: (start, end, tag, whether it ends an element, attributes), no tag for what is only left out."""

    def __init__(self, page: str):
        self.page = page
        self.last_mark = page.rfind(">")
        self.unended: set[str] = set()  # embedded elements that no further end tag closes
        self.unbalanced: set[int] = set()  # places of quotes and marks from which no attributes end

    def _attributes_end(self, at: int) -> int:
        """Where the tag whose attributes begin here ends, minding quotes, or -1."""
        seen = []
        while (m := QUOTES.search(self.page, at)) and m.start() not in self.unbalanced:
            if m.group() == ">":
                return m.start()
            seen.append(m.start())
            at = self.page.find(m.group(), m.end()) + 1
            if not at:
                break
        self.unbalanced.update(seen)
        return -1

    def __iter__(self) -> Iterator[tuple[int, int, str, bool, str]]:
        page, n = self.page, len(self.page)
        at = page.find("<")
        while at >= 0:
            end, tag, closes, attrs = self._one(at, n)
            if end > at:
                yield at, end, tag, closes, attrs
            at = page.find("<", max(end, at + 1))

    def _one(self, at: int, n: int) -> tuple[int, str, bool, str]:
        """The end of the markup at this place, or the place itself if it is text, and what it is."""
        page = self.page
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return (end + 3 if end >= 0 else n), "", False, ""
        m = NAME.match(page, at)
        if self.last_mark < at:
            cut_off = (m or page.startswith("</", at)) and page.find("<", at + 1) < 0
            return (n if cut_off else at), "", False, ""
        if page.startswith(("<!", "<?"), at):
            return page.find(">", at) + 1, "", False, ""
        if not m:
            return at, "", False, ""
        tag, closes = m.group(1).lower(), page[at + 1] == "/"
        mark = self._attributes_end(m.end())
        if mark < 0:
            return page.find(">", at) + 1, "", False, ""
        attrs = page[m.end() : mark]
        if not closes and tag in RAW:
            end = END_TAGS[tag].search(page, mark + 1)
            return (end.end() if end else n), "", False, ""
        if not closes and tag in EMBEDDED and not attrs.endswith("/") and tag not in self.unended:
            end = END_TAGS[tag].search(page, mark + 1)
            if end:
                return end.end(), "", False, ""
            self.unended.add(tag)
        return mark + 1, tag, closes, attrs


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """The elements in order and the blocks of text; end tags that are missing or stray are put up with."""
    nodes: list[Node] = []
    blocks: list[Block] = []
    stack: list[Node] = []
    bounding: list[int] = []  # places in the stack of elements that bound a block
    standing: Counter = Counter()  # how many elements of each tag are open
    current = Block(None)
    at = 0

    def add(text: str) -> None:
        if text:
            current.parts.append(text)
            if standing["a"]:
                current.link_chars += len(text)

    def close_block() -> None:
        nonlocal current
        if current.parts:
            blocks.append(current)
        current = Block(stack[-1] if stack else None)

    def pop_to(depth: int) -> None:
        for x in stack[depth:]:
            standing[x.tag] -= 1
        del stack[depth:]
        while bounding and bounding[-1] >= depth:
            bounding.pop()

    for start, end, tag, closes, attrs in Markup(page):
        add(page[at:start])
        at = end
        if not tag:
            continue
        if tag == "br":
            add(" ")
            continue
        if closes:
            if not standing[tag]:
                continue
            depth = len(stack) - 1
            while stack[depth].tag != tag:
                depth -= 1
            bounds = bool(bounding) and bounding[-1] >= depth
            pop_to(depth)
            if bounds:
                close_block()
            continue
        bounds = tag in BLOCK
        if bounds:  # a new block ends an open paragraph; an item ends the item before
            ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}.get(tag, ("p",))
            for i in reversed(bounding):
                if stack[i].tag in ends:
                    pop_to(i)
                    break
                if stack[i].tag != "p":
                    break
        node = _node(stack[-1] if stack else None, tag, attrs)
        nodes.append(node)
        if tag not in VOID and not attrs.endswith("/"):
            if bounds:
                bounding.append(len(stack))
            stack.append(node)
            standing[tag] += 1
        if bounds:
            close_block()
    add(page[at:])
    close_block()
    return nodes, blocks


def _text_token(block: Block, text: str) -> int:
    return _hash(f"{block.node.token if block.node else ''}={text}")


def page_sequence(source: str) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """The columns of SEQUENCE but host and page."""
    nodes, blocks = parse(source)
    tokens, around, chars, links, flags = columns = ([], [], [], [], [])
    at: dict[int, int] = {}
    placed = iter(nodes)

    def place(x: Node) -> None:
        at[id(x)] = len(tokens)
        for column, value in zip(columns, (x.token, at.get(id(x.parent), -1), -1, 0, MAIN * x.main + SKIP * x.skip + TOP * (x.tag in ("html", "body"))), strict=True):
            column.append(value)

    for b in blocks:
        inner = b.node
        while inner and id(inner) not in at:
            place(next(placed))
        if text := b.text():
            for column, value in zip(columns, (_text_token(b, text), at[id(inner)] if inner else -1, len(text), b.link_chars, MAIN * bool(inner and inner.main) + SKIP * bool(inner and inner.skip)), strict=True):
                column.append(value)
    for x in placed:
        place(x)
    return columns


class Members:
    """A host's classes, before they are judged."""

    def __init__(self, members: list[dict]):
        self.of = {m["token"]: m["class"] for m in members}
        self.sizes = Counter(self.of.values())
        counts = {m["token"]: m["n"] for m in members}
        self.texts = {m["token"]: m["parent"] for m in members if m["text"]}
        shared: Counter = Counter()
        for token, parent in self.texts.items():
            shared[parent] += counts[token]
        # elements that hold little but shared wording wherever they stand; what other elements share may be copied
        self.wording = {t for t, n in shared.items() if t in counts and n >= 0.9 * counts[t]}

    def facts(self, tokens: list[int], around: list[int], chars: list[int], links: list[int], flags: list[int]) -> Iterator[tuple]:
        """FACTS of a page, but host."""
        places: dict[int, list[int]] = defaultdict(list)
        elements: dict[int, list[int]] = defaultdict(list)
        slot: list[int] = []  # the lowest element of a class at or around each token
        for i, token in enumerate(tokens):
            known = self.of.get(token)
            if known is not None:
                places[known].append(i)
                if chars[i] < 0:
                    elements[known].append(i)
            slot.append(i if chars[i] < 0 and known is not None else slot[around[i]] if around[i] >= 0 else -1)
        article = self.article(tokens, chars, flags)
        for known, at in places.items():
            size = self.sizes[known]
            first = [tokens[i] for i in at[:size]]
            shape = len(set(first)) == size and len(at) % size == 0 and all(tokens[i] == first[k % size] for k, i in enumerate(at))
            nests = set()
            for i in at[::size] if shape else ():
                up = slot[around[i]] if around[i] >= 0 else -1
                while up >= 0 and self.of[tokens[up]] == known:
                    up = slot[around[up]] if around[up] >= 0 else -1
                outer = elements[self.of[tokens[up]]] if up >= 0 else []
                nests.add((self.of[tokens[up]], tokens[outer[bisect_left(outer, i) - 1]]) if up >= 0 else None)
            yield 0, known, _hash(repr((first, nests))) if shape and len(nests) == 1 else 0, article, 0, 0, False
        around_main = set()  # marked main parts and what is around them
        for i, flag in enumerate(flags):
            if flag & MAIN and chars[i] < 0 and not (around[i] >= 0 and flags[around[i]] & MAIN):
                while i >= 0 and i not in around_main:
                    around_main.add(i)
                    i = around[i]
        own: dict[int, list] = {}
        for i, token in enumerate(tokens):
            if slot[i] == i:
                up = slot[around[i]] if around[i] >= 0 else -1
                x = own.setdefault(token, [tokens[up] if up >= 0 else 0, 0, 0, False])
                x[3] = x[3] or bool(flags[i] & TOP) or i in around_main
            elif chars[i] >= 0 and slot[i] >= 0:
                own[tokens[slot[i]]][1] += chars[i]
                own[tokens[slot[i]]][2] += links[i]
        for token, (up, n, n_links, kept) in own.items():
            yield 1, token, up, 0, n, n_links, kept

    def article(self, tokens: list[int], chars: list[int], flags: list[int]) -> int:
        """Tells articles apart: the longest copied text if most of the page's text is copied, or else all of its texts."""
        texts = [(n, t) for t, n, f in zip(tokens, chars, flags, strict=True) if n >= 0 and not f & SKIP]
        copied = [x for x in texts if x[1] in self.texts and self.texts[x[1]] not in self.wording]
        own = sum(n for n, t in texts if t not in self.texts)
        return max(copied)[1] if sum(n for n, _ in copied) > own else _hash(repr([t for _, t in texts]))


class Template:
    def __init__(self, rows: list[dict], link_share: float = 0.6):
        self.fixed = {r["token"] for r in rows if r["text"]}
        elements = {r["token"]: r for r in rows if not r["text"]}
        self.bounds = {t for t, r in elements.items() if r["valid"]}
        worded: Counter = Counter()
        for r in rows:
            if r["text"]:
                worded[r["parent"]] += r["n"]
        wording = {t for t, r in elements.items() if worded[t] >= 0.9 * r["n"]}  # elements that hold fixed wording wherever they stand
        self.firm = {r["token"] for r in rows if r["firm"] and r["valid"] and (not r["text"] or r["parent"] in wording)}
        chars: Counter = Counter()
        links: Counter = Counter()
        kept = set()
        for token, r in elements.items():
            slot = token
            while slot and slot not in self.bounds:  # what no valid class bounds is part of the slot around it
                slot = elements[slot]["parent"] if slot in elements else 0
            chars[slot] += r["chars"]
            links[slot] += r["link_chars"]
            if r["kept"]:
                kept.add(slot)
        self.menus = {t for t in self.bounds - kept if links[t] > link_share * chars[t]}
        self.link_share = link_share

    def place(self, nodes: list[Node]) -> None:
        """Tell each element of a page, in order, its slot: the lowest bound at or around it."""
        for x in nodes:
            x.slot = x.token if x.token in self.bounds else x.parent.slot if x.parent else 0

    def is_menu(self, block: Block, length: int, token: int) -> bool:
        """Links and fixed wording of a slot of links; other text in it isn't the menu's."""
        return bool(block.node) and block.node.slot in self.menus and (block.link_chars > self.link_share * length or token in self.fixed)


@dataclass(slots=True)
class Piece:
    """A block of text: what the template says of it (a menu's, fixed wording, and whether it says so firmly) and what the labels say."""

    text: str
    menu: bool
    fixed: bool
    firm: bool
    main: bool
    skip: bool


def main_text(source: str, template: Template) -> str:
    """The page's main text, given the host's template."""
    nodes, blocks = parse(source)
    template.place(nodes)
    pieces = []
    for b in blocks:
        text, node = b.text(), b.node
        if text:
            token = _text_token(b, text)
            menu, fixed = template.is_menu(b, len(text), token), token in template.fixed
            firm = fixed and token in template.firm or menu and node.slot in template.firm
            pieces.append(Piece(text, menu, fixed, firm, bool(node and node.main), bool(node and node.skip)))
    left = [x for x in pieces if not x.skip and (x.main or not x.menu)]
    left = [x for x in left if not x.firm] or left
    marked = [x.text for x in left if x.main]
    free = [x.text for x in left if not x.fixed and not x.main]
    if marked and sum(map(len, marked)) >= sum(map(len, free)):
        return "\n\n".join(marked)
    # what is marked is the lesser part, as a teaser is beside the story
    return "\n\n".join(free or [x.text for x in left])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _frames(rows: Iterator[tuple], schema: str) -> Iterator[pd.DataFrame]:
    names = [re.split("[ :]", x)[0] for x in schema.split(", ")]
    while some := list(islice(rows, 20_000)):
        yield pd.DataFrame(some, columns=names)


def sent(of_hosts: DataFrame, column: str) -> DataFrame:
    """of_hosts, which is checkpointed, to be broadcast if its texts have at most SENT_BYTES; beyond, a join shuffles, and Spark may split a hot host."""
    size = of_hosts.agg(F.sum(F.octet_length(column) + F.octet_length("host") + 32)).first()[0] or 0
    return F.broadcast(of_hosts) if size <= SENT_BYTES else of_hosts


def templates(pages: DataFrame, least_share: float = 0.5, agreement: float = 0.9) -> DataFrame:
    """host, template: for each host with a template the elements and fixed wording of its classes.

    A host has at most 1 / least_share times the tokens of a page in its
    classes, so a row is no longer than a page or two.
    """

    def sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(((h, p, *page_sequence(x or "")) for pdf in batches for h, p, x in zip(pdf["host"], pdf["page"], pdf["source"], strict=True)), SEQUENCE)

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            for pdf in batches:
                for host, page, *lists in zip(*(pdf[c] for c in ("host", "page", "tokens", "around", "chars")), strict=True):
                    found, around, chars = (x.tolist() for x in lists)
                    parent = {t: found[i] if i >= 0 else 0 for t, i, n in zip(found, around, chars, strict=True) if n >= 0}
                    for token, n in Counter(found).items():
                        yield host, page, token, n, parent.get(token, 0), token in parent

        yield from _frames(rows(), TOKENS)

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            known: dict[str, Members] = {}
            for pdf in batches:
                for host, members, *page in zip(*(pdf[c] for c in ("host", "members", "tokens", "around", "chars", "links", "flags")), strict=True):
                    if host not in known:
                        if len(known) > 1000:
                            known.clear()
                        known[host] = Members(json.loads(members))
                    for row in known[host].facts(*(x.tolist() for x in page)):
                        yield host, *row

        yield from _frames(rows(), FACTS)

    # each row is a page of its own in the digest, or rows that repeat would cancel out
    page = F.xxhash64("page_id", "source", F.monotonically_increasing_id()).alias("page")
    parsed = checkpointed(pages.select("host", page, "source").mapInPandas(sequences, SEQUENCE))
    each = parsed.mapInPandas(tokens, TOKENS)
    seen = each.groupBy("host", "token", "text").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("n").alias("n"), F.bit_xor(F.xxhash64("page", "n")).alias("digest"), F.first("parent").alias("parent")
    ).where("pages > 1")
    of_host = pages.groupBy("host").agg(F.count(F.lit(1)).alias("of_host"))
    frequent = seen.join(of_host, "host").where(F.col("pages") >= least_share * F.col("of_host"))
    firm = F.max(F.col("pages") >= agreement * F.col("of_host")).alias("firm")
    classes = frequent.groupBy("host", "pages", "n", "digest").agg(F.collect_list(F.struct("token", "text", "parent")).alias("tokens"), firm).where("size(tokens) > 1")
    member = classes.select("host", "n", F.xxhash64("pages", "n", "digest").alias("class"), F.col("pages") == F.col("n"), "firm", F.explode("tokens").alias("t")).toDF("host", "n", "class", "once", "firm", "t")
    # a text that repeats on a page bounds no slot and is no wording of the template
    member = member.select("host", "t.token", "t.text", "t.parent", "n", "class", "firm", "once").where("once OR NOT text")
    of_class = F.struct("token", "text", "parent", "n", "class", "firm").cast(MEMBER)
    members = checkpointed(member.groupBy("host").agg(F.to_json(F.collect_list(of_class)).alias("members")))

    told = parsed.join(sent(members, "members"), "host").mapInPandas(facts, FACTS)
    article = told.groupBy("host", "kind", "id", "shape", "article").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"), F.sum("link_chars").alias("link_chars"), F.max("kept").alias("kept")
    )
    shape = article.groupBy("host", "kind", "id", "shape").agg(
        F.count(F.lit(1)).alias("articles"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("link_chars").alias("link_chars"), F.max("kept").alias("kept")
    )
    most = F.max(F.struct("pages", "shape", "articles"))
    judged = shape.groupBy("host", "kind", "id").agg(most.alias("most"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.sum("link_chars").alias("link_chars"), F.max("kept").alias("kept"))
    by_host = judged.groupBy("host").agg(
        F.max(F.when(F.col("kind") == 0, F.col("most.articles"))).alias("articles"),
        F.collect_list(F.struct("kind", "id", "most", "pages", "chars", "link_chars", "kept")).alias("facts"),
    )
    fits = f"x -> x.kind = 0 AND x.most.shape <> 0 AND x.most.pages >= {agreement} * x.pages AND x.most.articles >= greatest(2, {least_share} * articles)"
    valid = by_host.withColumn("valid", F.expr(f"transform(filter(facts, {fits}), x -> x.id)"))
    wording = f"transform(filter(members, m -> m.text AND articles > 2 AND array_contains(valid, m.class)), m -> named_struct('token', m.token, 'text', true, 'valid', true, 'parent', m.parent, 'n', m.n, 'chars', 0L, 'link_chars', 0L, 'kept', false, 'firm', m.firm AND articles >= {FIRM_ARTICLES}))"
    bounds = "transform(filter(members, m -> NOT m.text), m -> m)"
    of_token = "map_from_entries(transform(filter(facts, x -> x.kind = 1), x -> struct(x.id, x)))"
    slots = f"transform(elements, m -> named_struct('token', m.token, 'text', false, 'valid', array_contains(valid, m.class), 'parent', slot[m.token].most.shape, 'n', m.n, 'chars', slot[m.token].chars, 'link_chars', slot[m.token].link_chars, 'kept', slot[m.token].kept, 'firm', m.firm AND articles >= {FIRM_ARTICLES}))"
    members = members.withColumn("members", F.from_json("members", f"array<{MEMBER}>"))
    whole = valid.join(members, "host").withColumn("elements", F.expr(bounds)).withColumn("slot", F.expr(of_token))
    return whole.select("host", F.expr(f"to_json(concat({wording}, {slots}))").alias("template"))  # read once a host, not once a page


def extracted(pages: DataFrame) -> DataFrame:
    """Every row of pages with text and n_chars: the main text of the whole html and its code points.

    pages has page_id, url and html. Blocks are joined by an empty line, white space within one
    is a single space. A null html gives an empty text; a null or odd url belongs to the host
    "". Rows that repeat give their result each time, other columns stay (but
    text and n_chars, which are replaced), and an empty table gives an empty one.
    """
    host, template = free_name(pages, "host_of_page"), free_name(pages, "template_of_host")
    named = pages.withColumn(host, host_of(F.col("url")))
    found = checkpointed(templates(named.select(F.col(host).alias("host"), "page_id", F.col("html").alias("source"))))
    of_host = sent(found, "template").select(F.col("host").alias(host), F.col("template").alias(template))

    @F.pandas_udf("string")
    def extract(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, Template] = {}
        for hosts, sources, found in batches:
            out = []
            for name, source, rows in zip(hosts, sources, found, strict=True):
                if name not in known:
                    if len(known) > 1000:
                        known.clear()
                    known[name] = Template(json.loads(rows) if rows else [])
                out.append(main_text(source or "", known[name]))
            yield pd.Series(out, dtype=object)

    old = [c for c in pages.columns if c.lower() not in {"text", "n_chars"}]
    text = extract(F.col(host), F.col("html"), F.col(template))
    return named.join(of_host, host, "left").withColumn("text", text).select(*old, "text").withColumn("n_chars", F.length("text").cast("long"))
