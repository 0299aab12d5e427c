"""Main text of web pages by wrapper induction.

Every page is parsed into a tree of block elements, in which runs of equal siblings are one iterated node. The different trees of a host are aligned
by simple tree matching: labels must agree, and the children of matched nodes are aligned by dynamic programming. FAN trees or so make one, and those
are aligned again until one is left. It is the host's skeleton, and its nodes are slots. Then every page of the host is aligned with the skeleton, and
what stands in each slot is counted over all of them. A text that stands in one slot of most pages that fill it, and whose pages differ otherwise, is constant;
slots are told apart by the text that varies in them: those that hold the bulk of it outside links are content; a container beside them is template if
it holds links for the most part, or a form of words: words that recur there in most pages, and not in their prose (`decide`). How little text it holds doesn't matter. The skeleton with these decisions is the wrapper. A page is aligned with its
host's wrapper, and its text is the blocks of its content slots in page order, without constant texts and without elements whose tag, class or role marks
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments. Such marks are the one other feature: they
leave an element out of the counts and of the text. Ids of headings and paragraphs mark nothing, and inside an article only whole class names
of adverts, shares and comments do.

Alignment and tree walks use stacks, tags are found in one pass, and wrappers have DEPTH levels, below which blocks go with the slot above them. From KIDS slots under one
on, bare containers that the alignment leaves over share a slot with those of the same shape. Hosts with fewer than
TEMPLATE_PAGES different pages get no decisions: there marks decide alone, as they do for a page that fills no content slot.

Skeletons and counts come from all pages, and every page is extracted whole. Character references are decoded, white space inside a block
becomes one space, blocks are joined by two newlines. Null or empty html gives an empty text. A null or unreadable url is a host of its own, without a wrapper.
Unclosed and crossed tags close as browsers close them; a cut tag at the end is dropped. Repeated pages count once for constant texts and get equal texts. Of other
columns none are returned. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
from collections import Counter
from collections.abc import Generator, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelark.llm.common import BATCH_ROWS, Workspace, bounded, sifted

#: Trees that are aligned with one another at a time, about.
FAN = 16
#: A text is template if it stands in its slot in this share of the pages that fill the slot, in so many at least, and if
#: the pages that hold it have so many different other texts, by page.
TEMPLATE_SHARE, TEMPLATE_PAGES, KINDS_SHARE = 0.6, 4, 0.25
#: Shares of a host's varying text outside links: that makes main slots the content, and that a container holds to be entered.
MAIN_SHARE, MOST_SHARE = 0.3, 0.6
#: The share of links that makes a container beside the way template, and the share of words that recur in
#: TEMPLATE_SHARE of the pages that fill their slot, and aren't ordinary words of the pages' prose.
LINK_SHARE, FORM_SHARE = 0.8, 0.15
#: Levels of a wrapper, and the largest table of one alignment: beyond it children are matched by label alone.
DEPTH, CELLS = 64, 1_000_000
#: Slots under one from which on bare containers of one shape share theirs.
KIDS = 256
#: In place of a slot: the prose of the pages.
PROSE = -1

# HTML elements.
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol option optgroup p pre search section select summary table tbody td template tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes template svg audio video canvas".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
P_FENCE = ("button", "table", "td", "th", "caption")
ONE_CLOSED = ("li", "dt", "dd", "td", "th", "option")
NO_P_INSIDE = BLOCK - {"option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "button", "legend"}
DROPPED_TAGS = set("nav footer aside form button fieldset dialog menu search".split())
# Words of class, id and role names that mark what isn't main text.
DROPPED_WORDS = set("""ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices
notification alert popup modal overlay sidebar menu navbar nav navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist disqus
reply replies respond discussion share sharing sharer social related recommended recommendations newsletter subscribe subscription signup login signin search
pagination pager widget skip copyright disclaimer complementary contentinfo""".split())
#: Inside an article a section may be about discussion or ads; only whole class names of these, on plain containers, mark there.
ARTICLE_NAMES = set("ad ads advert adverts advertisement advertising adsense adslot sponsored cookies newsletter sidebar comment comments commentlist disqus share sharing sharer".split())
ARTICLE_TAGS = set("div ul ol".split())
CONTAINERS = set("div section article main header footer nav aside ul ol dl table tbody tr td center form body html details fieldset figure menu".split())
#: Containers that, without a class, id or role, may be anything.
BARE = {"div", "section"}
#: Elements of text: their ids are anchors made from titles.
TEXT_TAGS = set("h1 h2 h3 h4 h5 h6 p".split())
HEADER_WORDS = {"header", "siteheader", "pageheader"}
KEEP_TAGS = {"html", "body", "article", "main"}

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
INSIDE = re.compile(r"""[^>"']*""")
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """A block element: its kids are nodes and (text, characters of it in links) in page order."""

    __slots__ = ("drop", "kids", "label", "main", "slot", "tag")

    def __init__(self, tag: str, label: str, drop: bool, main: bool) -> None:
        self.tag, self.label, self.drop, self.main, self.kids, self.slot = tag, label, drop, main, [], None


def open_node(tag: str, attrs: str, in_main: bool, in_article: bool = False) -> Node:
    names: list[str] = []
    whole: set[str] = set()
    drop, main = tag in DROPPED_TAGS or (tag == "header" and not in_main), tag in ("article", "main")
    label = tag
    if attrs and not attrs.isspace():
        for m in ATTR.finditer(attrs):
            key = m[1].lower()
            if key in ("class", "id", "role") and not (key == "id" and tag in TEXT_TAGS):
                value = entities.unescape((m[2] or "").strip("\"'"))
                if key == "class":
                    whole.update(value.lower().split())
                words = SPLIT.split(CAMEL.sub("-", value).lower())
                names += words
                main |= key == "role" and value.strip().lower() == "main"
            elif key == "hidden" or (key == "aria-hidden" and "true" in (m[2] or "")) or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", m[2] or "")):
                drop |= tag not in ("html", "body")
        if names:
            label = f"{tag}.{'.'.join(w for w in names if w and not w.isdigit())}"
            if in_article and tag != "article":
                drop |= tag in ARTICLE_TAGS and not ARTICLE_NAMES.isdisjoint(whole)
            elif tag not in KEEP_TAGS and not main and tag not in TEXT_TAGS:
                drop |= not DROPPED_WORDS.isdisjoint(names) or (not in_main and not HEADER_WORDS.isdisjoint(names))
            elif tag == "article":
                drop |= not {"comment", "comments", "reply"}.isdisjoint(names)
    return Node(tag, label, drop, main)


def tags(source: str) -> Generator[tuple[str, str, str, int, int], int | None, None]:
    """(slash, name, attributes, start, end) of each tag in turn; the caller may send the position to go on from. One pass over the source.

    A quote that is open at the end of the source makes quotes count for nothing from there on; a tag cut by the end of the source is dropped.
    """
    at, n, quotes = 0, len(source), True
    while (start := source.find("<", at)) >= 0:
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            end = n if end < 0 else end + 3
            at = (yield "", "", "", start, end) or end
            continue
        slash = source.startswith("/", start + 1)
        name = NAME.match(source, start + 1 + slash)
        if name is None:
            if source.startswith(("!", "?", "/"), start + 1):
                end = source.find(">", start)
                end = n if end < 0 else end + 1
                at = (yield "", "", "", start, end) or end
            else:
                at = start + 1  # a bare character
            continue
        k = name.end()
        while quotes:
            k = INSIDE.match(source, k).end()
            if k >= n or source[k] == ">":
                break
            k = source.find(source[k], k + 1) + 1
            if not k:
                k = n
        if quotes and k >= n:
            quotes = False
        if not quotes:
            k = source.find(">", name.end())
        end = n if k < 0 else k + 1
        at = (yield ("/" if slash else ""), name[0].lower() if k >= 0 else "", source[name.end() : end - 1], start, end) or end


def parse(source: str, texts: bool = True) -> Node:
    """The tree of block elements, with or without their texts. Inline elements only pass their text on."""
    root = Node("", "", False, False)
    stack, text, mains, articles, links, linked = [root], [], 0, 0, 0, 0
    open_at: dict[str, list[int]] = {}
    at, n = 0, len(source)

    def flush() -> None:
        nonlocal linked
        if text:
            block = " ".join(entities.unescape("".join(text)).split())
            if block:
                stack[-1].kids.append((block, min(linked, len(block))))
            text.clear()
            linked = 0

    def close(k: int) -> None:
        """Close all elements from stack[k] on."""
        nonlocal mains, articles
        flush()
        for x in stack[k:]:
            mains -= x.main
            articles -= x.tag == "article"
            open_at[x.tag].pop()
        del stack[k:]

    def last(names: Iterable[str]) -> int:
        """Where the innermost open element of some names stands; 0 if none is open."""
        return max((open_at[t][-1] for t in names if open_at.get(t)), default=0)

    def say(part: str) -> None:
        nonlocal linked
        if part and texts:
            text.append(part)
            linked += len(part) if links else 0

    found = tags(source)
    item = next(found, None)
    while item is not None:
        slash, tag, attrs, start, end = item
        say(source[at:start])
        at, jump = end, None
        if not tag:
            pass
        elif slash:
            if tag in BLOCK:
                if k := last((tag,)):
                    close(k)
                else:
                    flush()
            elif tag == "a":
                links = 0
        elif tag in RAW:
            if not attrs.endswith("/"):
                shut = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = jump = shut.end() if shut else n
            if tag in BLOCK:
                flush()
        elif tag not in BLOCK:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                links = 1
        else:
            if tag in NO_P_INSIDE and (k := last(("p",))) > last(P_FENCE):
                close(k)
            if tag in CLOSES:
                while (k := last(CLOSES[tag])) > last(FENCE.get(tag, ())):
                    close(k)
                    if tag in ONE_CLOSED:
                        break
            flush()
            node = open_node(tag, attrs, mains > 0, articles > 0)
            stack[-1].kids.append(node)
            if tag not in VOID:
                open_at.setdefault(tag, []).append(len(stack))
                stack.append(node)
                mains += node.main
                articles += tag == "article"
        try:
            item = found.send(jump)
        except StopIteration:
            item = None
    say(source[at:])
    flush()
    return root


class Part(Node):
    """A slot of a skeleton that is aligned with another: it stands for a run already, so it makes none with its neighbours."""

    __slots__ = ()


def part(slot: Slot) -> Part:
    top = Part(slot.tag, slot.label, False, slot.main)
    todo = [(slot, top)]
    while todo:
        at, to = todo.pop()
        for kid in at.kids:
            to.kids.append(Part(kid.tag, kid.label, False, kid.main))
            todo.append((kid, to.kids[-1]))
    return top


def shape(node: Node) -> object:
    """What makes siblings next to each other one iterated node: the label, and for bare containers also the labels inside."""
    return frozenset(k.label for k in node.kids if isinstance(k, Node)) if node.label in BARE else None


def groups(node: Node) -> list[tuple[str, list[Node]]]:
    """The element children of a node as runs of one label and shape."""
    out: list[tuple[str, list[Node]]] = []
    last: object = None
    for kid in node.kids:
        if isinstance(kid, Node):
            own = kid if isinstance(kid, Part) else shape(kid)
            if out and out[-1][0] == kid.label and last == own:
                out[-1][1].append(kid)
            else:
                out.append((kid.label, [kid]))
            last = own
    return out


class Slot:
    """A node of a wrapper: its number in page order, its texts that are template, whether it is template as a whole, and whether its words decide that."""

    __slots__ = ("asked", "constant", "kids", "label", "main", "mode", "number", "template")

    def __init__(self, label: str, main: bool = False) -> None:
        self.label, self.main, self.kids, self.constant, self.template, self.asked, self.number, self.mode = label, main, [], frozenset(), False, False, 0, ""

    @property
    def tag(self) -> str:
        return self.label.split(".", 1)[0]


def in_order(root: Slot) -> list[Slot]:
    """All slots, parents before children, numbered."""
    found, todo = [], [root]
    while todo:
        slot = todo.pop()
        slot.number = len(found)
        found.append(slot)
        todo += reversed(slot.kids)
    return found


def dump(root: Slot) -> str:
    slots = in_order(root)
    above = {id(kid): slot.number for slot in slots for kid in slot.kids}
    return json.dumps([root.mode, [[x.label, above.get(id(x), -1), int(x.main), int(x.template), int(x.asked), sorted(x.constant)] for x in slots]])


@functools.lru_cache(maxsize=512)
def load(wrapper: str) -> Slot:
    slots: list[Slot] = []
    mode, rows = json.loads(wrapper)
    for label, above, main, template, asked, constant in rows:
        slot = Slot(label, bool(main))
        slot.constant, slot.number, slot.mode = frozenset(constant), len(slots), mode
        slot.template = bool(template or (above >= 0 and slots[above].template))
        slot.asked = bool(asked or (above >= 0 and slots[above].asked))
        slots.append(slot)
        if above >= 0:
            slots[above].kids.append(slot)
    return slots[0]


def match(slot: Slot, nodes: list[Node], memo: dict, depth: int = 0) -> int:
    """Simple tree matching: the most node pairs that an order-preserving alignment of the two trees holds."""
    key = (id(slot), id(nodes[0]))
    if key not in memo:
        runs = [g for x in nodes for g in groups(x)] if depth < DEPTH else []
        memo[key] = 1 + (table(slot.kids, runs, memo, depth)[-1][-1] if 0 < len(slot.kids) * len(runs) <= CELLS else 0)
    return memo[key]


def table(slots: list[Slot], runs: list[tuple[str, list[Node]]], memo: dict, depth: int = 0) -> list[list[int]]:
    rows = [[0] * (len(runs) + 1)]
    for s in slots:
        above, row = rows[-1], [0]
        for j, (label, nodes) in enumerate(runs):
            best = max(row[j], above[j + 1])
            if label == s.label:
                best = max(best, above[j] + match(s, nodes, memo, depth + 1))
            row.append(best)
        rows.append(row)
    return rows


def align(root: Slot, trees: list[Node], grow: bool, memo: dict) -> None:
    """Give trees (one run) the slot, and their children the slots of the best alignment; grow: new slots for those without one.

    Down to DEPTH levels; what lies deeper goes with the slot above it. Runs without a partner in the alignment take a slot of their label, if
    there is one (an iterated or moved node); bare containers, whose label says nothing, don't, unless the slot has KIDS others already: then their shape must be the same.
    """
    todo = [(root, trees, 0)]
    while todo:
        slot, members, depth = todo.pop()
        for x in members:
            x.slot = slot
        runs = [g for x in members for g in groups(x)] if depth < DEPTH else []
        if not runs:
            continue
        pairs = {}
        if len(slot.kids) * len(runs) <= CELLS:
            t = table(slot.kids, runs, memo, depth)
            i, j = len(slot.kids), len(runs)
            while i and j:
                if t[i][j] == t[i][j - 1]:
                    j -= 1
                elif t[i][j] == t[i - 1][j]:
                    i -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs[j] = i
        of_label: dict[object, Slot] = {}
        for k in slot.kids:
            of_label.setdefault((k.label, frozenset(x.label for x in k.kids)) if k.label in BARE else k.label, k)
        kids, done, many = [], 0, len(slot.kids)
        for j, (label, own) in enumerate(runs):
            if j in pairs:
                kids += slot.kids[done : pairs[j] + 1]
                done = pairs[j] + 1
                to = slot.kids[pairs[j]]
            else:
                known = (label, shape(own[0])) if label in BARE else label
                to = of_label.get(known) if label not in BARE or many >= KIDS else None
                if to is None and grow:
                    to = Slot(label, own[0].main)
                    kids.append(to)
                    many += 1
                    of_label.setdefault(known, to)
            if to is not None:
                todo.append((to, own, depth + 1))
        if grow:
            slot.kids = kids + slot.kids[done:]


def blocks(root: Node) -> Iterator[tuple[Node, Slot | None, bool, bool, str, int]]:
    """(node, nearest slot, under a mark, under main or article, text, characters in links) of each block in page order."""
    todo = [(iter(root.kids), root, root.slot, False, False)]
    while todo:
        kids, node, slot, drop, main = todo[-1]
        kid = next(kids, None)
        if kid is None:
            todo.pop()
        elif isinstance(kid, Node):
            todo.append((iter(kid.kids), kid, kid.slot or slot, drop or kid.drop, main or kid.main))
        else:
            yield node, slot, drop, main, *kid


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def tree_of(source: str) -> str:
    """The skeleton of one page."""
    root = Slot("")
    align(root, [parse(source, texts=False)], True, {})
    return dump(root)


def merged(trees: dict[str, int]) -> str:
    """The skeleton of some skeletons, with the number of pages of each: frequent ones come first, then it goes by hash."""
    root = Slot("")
    for tree in sorted(trees, key=lambda x: (-trees[x], text_hash(x), x)):
        align(root, [part(load.__wrapped__(tree))], True, {})
    return dump(root)


def words_of(source: str, root: Slot, every: bool = False) -> dict[int, Counter]:
    """The words outside links of a page, by slot: of those whose words are asked for, or of all. As PROSE those of its longest texts, that make up MOST_SHARE of it."""
    tree = parse(source)
    align(root, [tree], False, {})
    found: dict[int, Counter] = {}
    texts = []
    for _, slot, drop, _, text, linked in blocks(tree):
        if not drop and linked < len(text):
            words = text.lower().split()
            texts.append((len(text), words))
            if every or slot.asked:
                found.setdefault(slot.number, Counter()).update(words)
    left, found[PROSE] = MOST_SHARE * sum(n for n, _ in texts), Counter()
    for n, words in sorted(texts, key=lambda x: -x[0]):
        if left <= 0:
            break
        left -= n
        found[PROSE].update(words)
    return found


def recurring(root: Slot, pages: list[str]) -> dict[int, tuple[int, int]]:
    """The words outside links by slot: how many of them recur there and are no ordinary words, and how many there are; what `recurring_words` finds with Spark.

    A word recurs if it stands in TEMPLATE_SHARE of the different pages, two at least, that fill the slot. Ordinary words are those that so many pages have in their prose.
    """
    found = [words_of(x, root, every=True) for x in dict.fromkeys(pages) if x]
    held: dict[int, list[Counter]] = {}
    for page in found:
        for k, words in page.items():
            held.setdefault(k, []).append(words)
    often = {k: {w for w, n in Counter(w for words in own for w in words).items() if n >= max(2, TEMPLATE_SHARE * len(own))} for k, own in held.items()}
    ordinary = often.get(PROSE, set())
    return {k: (sum(n for words in own for w, n in words.items() if w in often[k] and w not in ordinary), sum(words.total() for words in own)) for k, own in held.items() if k != PROSE}


def facts(source: str | None, root: Slot) -> list[tuple[int, int, int, int]]:
    """(slot, text hash, characters outside links, characters in links) of the distinct unmarked texts of a page, by slot."""
    if not source:
        return []
    tree = parse(source)
    align(root, [tree], False, {})
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for _, slot, drop, _, text, linked in blocks(tree):
        if not drop:
            key = (slot.number, text_hash(text))
            chars, links = found.get(key, (0, 0))
            found[key] = (chars + len(text) - linked, links + linked)
    return [(*key, *x) for key, x in found.items()]


def decide(root: Slot, pages: int, weight: dict[int, tuple[int, int]], constant: dict[int, list[int]], said: dict[int, tuple[int, int]] | None = None) -> None:
    """Mark slots as template. weight: characters of varying texts outside and inside links, by slot; constant: template texts by slot; said: words that recur and all
    words, by slot. Without said, slots whose words would decide are marked as asked.

    The main slots are read if they hold MAIN_SHARE of the varying text outside links. Otherwise the wrapper is entered from the root while one container
    holds MOST_SHARE of that text, and beside this way containers that hold no varying text, links for the most part, or words that recur for the most part, are template
    unless they hold a title.
    """
    slots = in_order(root)
    for slot in slots:
        slot.constant, slot.template, slot.asked = frozenset(constant.get(slot.number, ())), False, False
    if pages < TEMPLATE_PAGES:
        return
    own = np.array([weight.get(x.number, (0, 0)) for x in slots], np.float64).reshape(-1, 2)
    titled = [x.tag == "h1" and own[x.number].sum() > 0 for x in slots]
    above = {kid.number: slot.number for slot in slots for kid in slot.kids}
    words = np.array([(said or {}).get(x.number, (0, 0)) for x in slots], np.float64).reshape(-1, 2)
    for k in range(len(slots) - 1, 0, -1):
        own[above[k]] += own[k]
        words[above[k]] += words[k]
        titled[above[k]] |= titled[k]
    total = own[0, 0]
    if not total:
        return
    mains, todo = [], [root]
    while todo:
        slot = todo.pop()
        if slot.main:
            mains.append(slot)
        else:
            todo += slot.kids
    if sum(own[x.number, 0] for x in mains) >= MAIN_SHARE * total:
        root.mode, inside = "main", {x.number for x in mains}
        on_way = set(inside)
        for k in range(len(slots) - 1, 0, -1):
            if k in on_way:
                on_way.add(above[k])
        todo = [root]
        while todo:
            slot = todo.pop()
            if slot.number not in inside:
                slot.template = slot.number not in on_way
                todo += slot.kids
        return
    root.mode, at = "weight", root
    while True:
        best = max((k for k in at.kids if k.tag in CONTAINERS), key=lambda k: own[k.number, 0], default=None)
        if best is None or own[best.number, 0] < MOST_SHARE * total:
            return
        for k in at.kids:
            linked = own[k.number, 1] >= LINK_SHARE * own[k.number].sum()  # or there is nothing that varies
            form = words[k.number, 0] >= FORM_SHARE * words[k.number, 1] > 0
            beside = k is not best and k.tag in CONTAINERS and not titled[k.number]
            k.template, k.asked = beside and bool(linked or form), beside and said is None and not linked
        at = best


def induce(pages: list[str]) -> str:
    """The wrapper of some pages of one host, as JSON: what `wrappers` finds with Spark, for one host in memory."""
    root = load.__wrapped__(merged(Counter(tree_of(x) for x in pages if x)))
    found = [facts(x, root) for x in pages]
    filled = Counter(s for page in found for s in {x[0] for x in page})
    count = Counter((x[0], x[1]) for page in found for x in page)
    often = {key for key, n in count.items() if n >= max(TEMPLATE_PAGES, TEMPLATE_SHARE * filled[key[0]])}
    rest = [hash(tuple(sorted(h for s, h, _, _ in page if (s, h) not in often))) for page in found]
    kinds: dict[tuple[int, int], set[int]] = {}
    for page, r in zip(found, rest, strict=True):
        for s, h, _, _ in page:
            if (s, h) in often:
                kinds.setdefault((s, h), set()).add(r)
    constant: dict[int, list[int]] = {}
    for (s, h), own in kinds.items():
        if len(own) >= max(TEMPLATE_PAGES, KINDS_SHARE * count[s, h]):
            constant.setdefault(s, []).append(h)
    weight: dict[int, tuple[int, int]] = {}
    for page in found:
        for s, h, chars, links in page:
            if h not in constant.get(s, ()):
                c, k = weight.get(s, (0, 0))
                weight[s] = (c + chars, k + links)
    decide(root, len(set(rest)), weight, constant, recurring(root, pages))
    return dump(root)


def extract(source: str | None, wrapper: str | None = None) -> str:
    """The main text of a page: what its host's wrapper takes for content, without marked elements. Without a wrapper that decides, and for a
    page that fills no content slot, marks decide alone: main and article elements whole, if the page has any, else all that is not marked."""
    if not source:
        return ""
    tree = parse(source)
    root = load(wrapper) if wrapper else Slot("")
    if wrapper:
        align(root, [tree], False, {})
    found = [x for x in blocks(tree) if not x[2]]
    within = [x for x in found if x[3]] or found
    aligned = [x for x in found if x[1] is not None and not x[1].template] if root.mode else []
    if root.mode == "main" and within is not found:
        aligned = [x for x in aligned if x[3] or x[0].slot is not None]
    fresh = lambda rows: [x[4] for x in rows if x[0].slot is None or text_hash(x[4]) not in x[0].slot.constant]
    return "\n\n".join(fresh(aligned) or fresh(within))


def host(url: str = "url") -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def skeletons(ws: Workspace, pages: DataFrame) -> DataFrame:
    """(host, skeleton): one row a host, of all its pages. Each different tree of a host is kept once; they are dealt out by hash to groups of about FAN,
    a group makes one tree, and so on until every host has one. The groups follow the trees alone, so the result doesn't depend on how pages are stored."""
    some = pages.select(host().alias("host"), "html").where("host <> '' and html <> ''")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = Counter((h, tree_of(x)) for h, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            columns = [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(found.values(), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["host", "skeleton", "n"])

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [key[0]], "skeleton": [merged(pdf.groupby("skeleton")["n"].sum().to_dict())], "n": [pdf["n"].sum()]})

    schema = "host string, skeleton string, n bigint"
    found = some.mapInArrow(trees, schema).groupBy("host", "skeleton").agg(F.sum("n").alias("n"))
    found, k = ws.save(found, "trees-0", compression="zstd"), 0
    while k == 0 or most > 1:
        counts = ws.save(found.groupBy("host").agg(F.ceil(F.count("*") / FAN).alias("groups")), f"trees-of-{k}")
        most = counts.agg(F.max("groups")).first()[0] or 0
        dealt = found.join(bounded(counts), "host").withColumn("group", F.pmod(F.xxhash64(F.lit(k), "skeleton"), "groups"))
        k += 1
        found = ws.save(dealt.select("host", "group", "skeleton", "n").groupBy("host", "group").applyInPandas(fit, schema), f"trees-{k}", compression="zstd")
    return found.select("host", "skeleton")


def page_facts(pages: DataFrame, fitted: DataFrame) -> DataFrame:
    """(host, slots, hashes, chars, links): the facts of every page of a host with a skeleton."""
    joined = pages.select(host().alias("host"), "html").where("html is not null").join(bounded(fitted), "host").select("host", "html", "skeleton")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [facts(h, load(w)) for h, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            columns = [pa.array([[x[k] for x in page] for page in found], pa.list_(pa.int64())) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["host", "slots", "hashes", "chars", "links"])

    return joined.mapInArrow(run, "host string, slots array<bigint>, hashes array<bigint>, chars array<bigint>, links array<bigint>")


def recurring_words(ws: Workspace, pages: DataFrame, asking: DataFrame) -> DataFrame:
    """(host, said): for the hosts of asking (host, wrapper), the words that recur and all words of each slot that is asked for, over the different pages of the host.

    Pages that occur once aren't shuffled; words are counted by batch first.
    """
    own = pages.select(host().alias("host"), "html").where("html <> ''").join(bounded(asking), "host").withColumn("h", F.xxhash64("host", "html"))
    twice = ws.save(own.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "pages-twice")
    some, single = sifted(own, twice, "h")
    columns = ["host", "html", "wrapper"]
    once = some.dropDuplicates(["host", "h"]).select(columns).unionByName(single.select(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, said = Counter(), Counter()  # a word of None: all of them
            for name, source, wrapper in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for slot, words in words_of(source, load(wrapper)).items():
                    held.update((name, slot, w) for w in [None, *words])
                    if slot != PROSE:
                        said.update({(name, slot, None): words.total()} | {(name, slot, w): n for w, n in words.items()})
            keys = list(held)
            word = [None if k[2] is None else text_hash(k[2]) for k in keys]
            found = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array(word, pa.int64()), pa.array(held.values(), pa.int64()), pa.array([said[k] for k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(found, ["host", "slot", "word", "pages", "n"])

    counted = once.mapInArrow(run, "host string, slot bigint, word bigint, pages bigint, n bigint")
    counted = ws.save(counted.groupBy("host", "slot", "word").agg(F.sum("pages").alias("pages"), F.sum("n").alias("n")), "words", compression="zstd")
    every = counted.where("word is null").select("host", "slot", F.col("pages").alias("filled"), F.col("n").alias("every"))
    often = counted.where("word is not null and pages >= 2").join(every, ["host", "slot"]).where(F.col("pages") >= TEMPLATE_SHARE * F.col("filled"))
    often = ws.save(often.select("host", "slot", "word", "n"), "words-often")
    ordinary = often.where(F.col("slot") == PROSE).select("host", "word")
    recur = often.where(F.col("slot") != PROSE).join(ordinary, ["host", "word"], "left_anti").groupBy("host", "slot").agg(F.sum("n").alias("recur"))
    both = every.where(F.col("slot") != PROSE).join(recur, ["host", "slot"], "left").select("host", "slot", F.coalesce("recur", F.lit(0)).alias("recur"), "every")
    return both.groupBy("host").agg(F.collect_list(F.struct("slot", "recur", "every")).alias("said"))


def wrappers(ws: Workspace, pages: DataFrame) -> DataFrame:
    """(host, wrapper): one row a host. The skeleton and every count come from all pages of the host.

    A text is template if it stands in TEMPLATE_SHARE of the pages that fill its slot, and these pages differ in their other texts: copies of
    one page make no template. All counts are pre-aggregated by (host, slot, text), so a hot host is spread over tasks.
    """
    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    fitted = skeletons(ws, pages)
    found = ws.save(page_facts(pages, fitted), "facts", compression="zstd")
    each = found.select("host", F.explode(F.arrays_zip("slots", "hashes", "chars", "links")).alias("x")).select("host", F.col("x.slots").alias("slot"), F.col("x.hashes").alias("hash"), "x.chars", "x.links")
    texts = ws.save(each.groupBy("host", "slot", "hash").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links")), "texts", compression="zstd")
    filled = found.select("host", F.explode(F.array_distinct("slots")).alias("slot")).groupBy("host", "slot").agg(F.count("*").alias("filled"))
    often = texts.where(F.col("n") >= TEMPLATE_PAGES).join(filled, ["host", "slot"]).where(F.col("n") >= TEMPLATE_SHARE * F.col("filled")).select("host", "slot", "hash", "n")
    often = ws.save(often, "often")
    lists = ws.save(often.groupBy("host").agg(F.collect_list(F.struct(F.col("slot").alias("slots"), F.col("hash").alias("hashes"))).alias("often")), "often-by-host")
    pairs = found.select("host", F.arrays_zip("slots", "hashes").alias("pairs")).join(bounded(lists), "host", "left")
    is_often = lambda p: F.coalesce(F.array_contains(F.col("often"), p), F.lit(False))
    rest = F.xxhash64(F.array_sort(F.transform(F.filter("pairs", lambda p: ~is_often(p)), lambda p: p["hashes"])))
    kinds = pairs.select("host", rest.alias("rest"), F.filter("pairs", is_often).alias("own"))
    kinds = ws.save(kinds.select("host", "rest", F.explode_outer("own").alias("p")).select("host", "rest", F.col("p.slots").alias("slot"), F.col("p.hashes").alias("hash")).distinct(), "kinds", compression="zstd")
    distinct = kinds.where("hash is not null").groupBy("host", "slot", "hash").agg(F.count("*").alias("kinds"))
    constant = often.join(distinct, ["host", "slot", "hash"]).where(F.col("kinds") >= F.greatest(F.lit(TEMPLATE_PAGES), KINDS_SHARE * F.col("n"))).select("host", "slot", "hash")
    constant = ws.save(constant, "constant")
    sums = texts.join(constant, ["host", "slot", "hash"], "left_anti").groupBy("host", "slot").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    of = lambda rows, name, *columns: rows.groupBy("host").agg(F.collect_list(F.struct(*columns)).alias(name))
    n_pages = kinds.select("host", "rest").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    by_host = fitted.join(n_pages, "host", "left").join(of(sums, "weights", "slot", "chars", "links"), "host", "left").join(of(constant, "constant", "slot", "hash"), "host", "left")

    by_host = ws.save(by_host.select("host", "skeleton", "pages", "weights", "constant"), "by-host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, asked = [], []
            for _, shape, n, weights, fixed, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                root, texts_of = load.__wrapped__(shape), {}
                for x in fixed or ():
                    texts_of.setdefault(x["slot"], []).append(x["hash"])
                said = {x["slot"]: (x["recur"], x["every"]) for x in rest[0] or ()} if rest else None
                decide(root, n or 0, {x["slot"]: (x["chars"], x["links"]) for x in weights or ()}, texts_of, said)
                out.append(dump(root))
                asked.append(any(x.asked for x in in_order(root)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(asked, pa.bool_())], ["host", "wrapper", "asked"])

    schema = "host string, wrapper string, asked boolean"
    decided = ws.save(by_host.mapInArrow(run, schema), "decided")
    asking = decided.where("asked").select("host", "wrapper")
    if asking.isEmpty():
        return decided.select("host", "wrapper")
    said = by_host.join(asking.select("host"), "host").join(recurring_words(ws, pages, asking), "host", "left").mapInArrow(run, schema)
    return decided.where("not asked").unionByName(said).select("host", "wrapper")


def extract_pages(ws: Workspace, pages: DataFrame) -> DataFrame:
    """(page_id, url, text) for every page."""
    fitted = ws.save(wrappers(ws, pages), "wrappers")
    joined = pages.select("page_id", "url", "html", host().alias("host")).join(bounded(fitted), "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [extract(h, w) for h, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return joined.select("page_id", "url", "html", "wrapper").mapInArrow(run, "page_id bigint, url string, text string")
