"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by where they stand: the nearest block and, but in paragraphs and headings, whether
they are in a link. Tags score by their name, and words under names of elements (class words, and tags such as nav) that speak against
them count against a stretch. The weights are log odds counted on labelled pages: pages that mark their article (``article``,
``main``) label their own words and tags. Extraction never looks at those marks: one linear scan finds the contiguous stretch of the
greatest sum, and what it holds outside elements whose names speak against it is the main text. The names that web pages commonly
give to their other parts are a prior, which stands until labelled pages say more, and not for an element that holds most of its page.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm._common import map_batches, slices, stage

# Names of HTML elements and of their classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split()
)
DROPPED = frozenset("head script style noscript template title button select option textarea input iframe object svg math canvas audio video datalist".split())
NAMED = frozenset("nav footer header aside form dialog menu fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ARTICLE = frozenset(("article", "main"))
PARTS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu submenu sidebar aside footer "
    "header masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup share sharing "
    "social related recommended recommendations comment comments commentlist disqus reply replies respond form login search toolbar pagination pager copyright legal widget "
    "widgets hidden skip".split()
)
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
HEADINGS = frozenset(("h1",))

_RAW = "script|style|title|textarea|template|iframe|noembed|noframes|xmp"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest2>[^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_LETTERS = re.compile(r"[a-z]+")


#: Words (or tags) that a weight rests on at least; a name's share of all names' words from which it is held (so there are fewer than its inverse);
#: log odds from which a name speaks against its words; share of a name's words within articles from which a stretch runs on across them.
ENOUGH, LEAST_SHARE, AGAINST, WITHIN = 20, 1e-5, -1.0, 0.05
#: Shares of a page's words that no part beside its main text has: with its heading, and without one.
MOST, NEARLY_ALL = 0.5, 0.9
#: What a word counts under a name that speaks against it, and bounds of words' and tags' weights. What is on neither side of an article is crossed at
#: little cost, and what stands beside it is left out at any.
SET_ASIDE, LINKED, WORD_RANGE, TAG_RANGE = -0.25, -0.25, (-0.5, 2.0), (-0.3, -0.1)
NOWHERE = "<none>"


def listed(name: str) -> bool:
    """Whether a name commonly stands for something else than main text."""
    return name[0] == "<" or name in PARTS


@lru_cache(1 << 14)
def _names(name: str, rest: str) -> tuple[str, ...]:
    if name in DROPPED:
        return (NOWHERE,)
    out = [f"<{name}"] if name in NAMED else []
    if rest:
        if _HIDDEN.search(rest) and name not in ("html", "body"):
            return (NOWHERE,)
        if name not in ("html", "body"):  # their classes describe the page
            for m in _NAMES.finditer(rest):
                out += _LETTERS.findall(m[1].strip("\"'").lower())
    return tuple(dict.fromkeys(out))


def names_of(name: str, rest: str) -> tuple[str, ...]:
    """Names by which an element may be told apart: NAMED tags, and the words of its class, id and role; a DROPPED or hidden one has ``<none>``."""
    return _names(name, rest) if len(rest) < 200 else _names.__wrapped__(name, rest)


class Node:
    """An element: its names, the element around it, whether it is in the marked article, and what it holds."""

    __slots__ = ("above", "heading", "inside", "names", "score", "told", "words")

    def __init__(self, names: tuple[str, ...], above: Node | None, opens: bool):
        self.names, self.above, self.words, self.heading, self.score = names, above, [0, 0, 0], False, None
        self.inside = opens or (above is not None and above.inside)
        # Listed names count from the article on, which is no part of what stands around it.
        self.told = not (opens and not (above is not None and above.inside)) and ((above is not None and above.told) or any(map(listed, names)))

    @property
    def nowhere(self) -> bool:
        return NOWHERE in self.names


class Page:
    """A page in order: events ("tag", name, node) and ("text", context, node, text, block, words), and its nodes from the outermost on.

    Every step is linear in the page: open blocks and elements are found by their name, and what a name says is handed down.
    """

    def __init__(self, page: str):
        self.events: list[tuple] = []
        self.nodes = [Node((), None, False)]
        self.marked = False
        stack: list[tuple[str, Node]] = [("", self.nodes[0])]
        at_name: dict[str, list[int]] = defaultdict(list)
        blocks, links, block, at = [0], 0, 0, 0

        def close(k: int) -> None:
            nonlocal links
            while len(stack) > k:
                name, _ = stack.pop()
                at_name[name].pop()
                if blocks[-1] == len(stack):
                    blocks.pop()
                links -= name == "a"

        def text(words: str) -> None:
            node, n = stack[-1][1], len(words.split())
            context = stack[blocks[-1]][0] or "none"
            context = "div" if context in ARTICLE else context
            if n:
                if not node.nowhere:
                    node.words[2 if node.inside and node.told else int(node.inside)] += n
                if context in HEADINGS:
                    node.heading = True
            self.events.append(("text", context if not links or context in PROSE else context + ":link", node, words, block, n))

        for m in _TOKEN.finditer(page):
            if m.start() > at:
                text(page[at : m.start()])
            at = m.end()
            name = m["name"] or m["name2"]
            if not name:
                continue
            name, rest = name.lower(), m["rest"] or m["rest2"] or ""
            shown = "other" if name in ARTICLE else name if name in BLOCKS or name in INLINE or name in VOID else "other"
            if name not in INLINE:
                block += 1
            node = stack[-1][1]
            if m["end"] or m["end2"]:
                if at_name[name]:
                    k = at_name[name][-1]
                    node = stack[k][1]
                    close(k)
            elif name not in VOID and not rest.endswith("/"):
                if name in BLOCKS and stack[blocks[-1]][0] == "p":  # a block ends an open paragraph, with what is open in it
                    close(blocks[-1])
                names, above = names_of(name, rest), stack[-1][1]
                opens = name in ARTICLE and not above.inside
                self.marked |= opens
                node = above
                if names or opens:
                    node = Node((NOWHERE,) if above.nowhere else names, above, opens)
                    self.nodes.append(node)
                at_name[name].append(len(stack))
                if name in BLOCKS:
                    blocks.append(len(stack))
                links += name == "a"
                stack.append((name, node))
            self.events.append(("tag", shown, node))
        if at < len(page):
            text(page[at:])
        for node in reversed(self.nodes[1:]):
            above = node.above
            above.words = [x + y for x, y in zip(above.words, node.words, strict=True)]
            above.heading |= node.heading


def counts(page: str) -> Counter:
    """On a page that marks its article: how often each kind of word, tag and name is in it (1) and outside (0).

    What stands in the article under a listed name is no example of main text: it counts for nothing but how
    much of that name is within articles (2).
    """
    seen = Page(page)
    out: Counter = Counter()
    if not seen.marked:
        return out
    for node in seen.nodes[1:]:
        if not node.nowhere:
            for x in node.names:
                for side in (0, 1, 2) if node.inside else (0, 1):
                    if node.words[side]:
                        out["name", x, side] += node.words[side]
    for e in seen.events:
        node = e[2]
        if node.nowhere or (node.inside and node.told):
            continue
        if e[0] == "tag":
            out["all tag", e[1], int(node.inside)] += 1
            if not node.told:
                out["tag", e[1], int(node.inside)] += 1
        elif e[5]:
            out["all", e[1], int(node.inside)] += e[5]
            if not node.told:
                out["left", e[1], int(node.inside)] += e[5]
    return out


class Weights:
    """Scores of words by where they stand and of tags by their name, as clipped log odds, from counts (kind, name, 0 to 2)."""

    def __init__(self, n: dict[tuple[str, str, int], int]):
        self.n = n
        self._against: dict[str, float | None] = {}

    def _odds(self, kind: str, name: str) -> float | None:
        inside, outside = self.n.get((kind, name, 1), 0), self.n.get((kind, name, 0), 0)
        return math.log((inside + 0.5) / (outside + 0.5)) if inside + outside >= ENOUGH else None

    def name(self, name: str) -> float | None:
        """None for a name that does not speak against its words; else their score."""
        if name not in self._against:
            odds = self._odds("name", name)
            against = name == NOWHERE or (listed(name) if odds is None else odds < AGAINST)
            within, outside = self.n.get(("name", name, 2), 0), self.n.get(("name", name, 0), 0)
            self._against[name] = None if not against else 0.0 if name == NOWHERE or within > WITHIN * (within + outside) else SET_ASIDE
        return self._against[name]

    def judge(self, page: Page) -> None:
        """Sets every node's score: the least of what the names around it say against its words, or None.

        An element that holds most of the page's words and its heading, or nearly all of a page without one, is a part of nothing: its names
        say nothing. Comments of readers are never taken for a page.
        """
        root = page.nodes[0]
        total = sum(root.words)
        for node in page.nodes[1:]:
            said = [(x, v) for x in node.names if (v := self.name(x)) is not None]
            words = sum(node.words)
            if said and not node.nowhere and (words > MOST * total if node.heading else not root.heading and words > NEARLY_ALL * total and not READERS.intersection(x for x, _ in said)):
                said = []
            scores = [v for _, v in said] + ([node.above.score] if node.above.score is not None else [])
            node.score = min(scores, default=None)

    def word(self, context: str) -> float:
        """By the words there that no listed name explains; in links, where there are too few, by all of them. Words of unknown places count 1, in links against."""
        odds, linked = self._odds("left", context), context.endswith(":link")
        if odds is None and (linked or context in ("div", "none")):
            odds = self._odds("all", context)
        if odds is None:
            return LINKED if linked else 1.0
        return min(WORD_RANGE[1], max(WORD_RANGE[0], odds))

    def tag(self, name: str) -> float:
        odds = self._odds("tag", name)
        return TAG_RANGE[1] if odds is None else min(TAG_RANGE[1], max(TAG_RANGE[0], odds))


def stretch(page: Page, weights: Weights) -> tuple[int, int]:
    """Begin and end of the contiguous events of the greatest sum, in one scan."""
    weights.judge(page)
    best = total = 0.0
    start, found = 0, (0, 0)
    for i, score in enumerate(scores(page, weights)):
        total += score
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, found = total, (start, i + 1)
    return found


def scores(page: Page, weights: Weights):
    """What each event of a judged page adds to a stretch; under names that labelled pages have within articles too, nothing."""
    words, tags = {}, {}
    for e in page.events:
        against = e[2].score
        if e[0] == "tag":
            if e[1] not in tags:
                tags[e[1]] = weights.tag(e[1])
            yield 0.0 if against == 0.0 else tags[e[1]]
        elif against is not None:
            yield against * e[5]
        else:
            if e[1] not in words:
                words[e[1]] = weights.word(e[1])
            yield words[e[1]] * e[5]


def extract(page: str, weights: Weights) -> str:
    """Main text of ``page``: the blocks of its best stretch, joined by line feeds.

    What is set apart by names counts a little against a stretch, or neither way where labelled pages have it within articles too, so
    that the stretch runs on behind it; it is left out of the text.
    """
    seen = Page(page)
    begin, end = stretch(seen, weights)
    blocks: dict[int, list[str]] = defaultdict(list)
    for e in seen.events[begin:end]:
        if e[2].score is None:
            if e[0] == "text":
                blocks[e[4]].append(e[3])
            elif e[1] == "br" and blocks:
                blocks[next(reversed(blocks))].append(" ")
    texts = (" ".join(html.unescape("".join(b)).split()) for b in blocks.values())
    return "\n".join(t for t in texts if t)


def learn(pages: DataFrame) -> Weights:
    """Counts over every page of ``pages`` that marks its article, added up by task before they are shuffled.

    Class words are held that stand over ``ENOUGH`` words and over ``LEAST_SHARE`` of the words under all of them, so their number
    is bounded whatever the corpus; rarer ones rest on the prior. Tags and contexts are of fixed lists.
    """

    def work(batches):
        def rows(total):
            keys = list(total)
            return {"kind": [k[0] for k in keys], "name": [k[1] for k in keys], "side": [k[2] for k in keys], "n": [total[k] for k in keys]}

        total: Counter = Counter()
        for whole in batches:
            for page in whole["html"].to_pylist():
                total.update(counts(page or ""))
                if len(total) > 1 << 18:
                    yield rows(total)
                    total = Counter()
        yield rows(total)

    n = map_batches(pages.select("html"), work, "kind string, name string, side int, n long").groupBy("kind", "name")
    n = stage(n.agg(*(F.sum(F.when(F.col("side") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(3))), "names")
    every, named = F.col("n0") + F.col("n1") + F.col("n2"), F.col("kind") == "name"
    total = n.where(named).agg(F.coalesce(F.sum(every), F.lit(0)).alias("n")).first().n
    found = n.where(~named | (every >= max(ENOUGH, LEAST_SHARE * total))).collect()  # 1 / LEAST_SHARE names at most
    return Weights({(r.kind, r.name, k): r[f"n{k}"] for r in found for k in range(3)})


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; see the contract of ``op3_main_text``.

    A null or empty html gives the empty text, and so does a page without words in its main
    part. Repeated rows, null ids and urls pass through. An empty table gives no rows; without
    labelled pages words score 1, linked ones -0.25 and tags -0.1. Nothing is shuffled.
    """
    weights = weights or learn(pages)

    def work(batches):
        for whole in batches:
            for b in slices(whole, "html"):
                texts = [extract(p or "", weights) for p in b["html"].to_pylist()]
                yield {"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return map_batches(pages.select("page_id", "url", "html"), work, "page_id long, url string, text string, n_chars long")
