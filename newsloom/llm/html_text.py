"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags. The first pass labels each block of a page
by itself: bad inside navigation, forms, adverts, notices or comments, and where links are
dense; else by length and by its share of stop words, where short ones stay open. The second
pass gives open blocks the label of their nearest decided neighbours: good between good
ones, else bad.

Article elements are a feature of the second pass, and only where the first pass bears them
out: one that holds a good block, or any if the page has no good block at all. There, blocks
that aren't good are open unless links are dense, and its edges are good neighbours. So
teasers in article elements win nothing against a text elsewhere on the page.

Stop words of four languages are known. A page whose text holds next to none of them is judged by
length and links alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.workers import slices

SLICE_BYTES = 8 << 20
# Elements whose content is never text.
SILENT = "script|style|noscript|template|title|svg|math|iframe|object|textarea|select|button|canvas|video|audio"
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img br input".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements, and words in class, id and role, that are not the article.
ASIDE = frozenset("nav aside footer form menu dialog".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert popup modal overlay sidebar aside widget menu nav navbar navigation breadcrumb "
    "breadcrumbs pagination pager footer masthead topbar toolbar share sharing social related recommended newsletter "
    "subscribe subscription signup login comment comments respond reply replies disqus discussion search "
    "complementary contentinfo skip".split()
)
# Beginnings of further such words.
ASIDE_STARTS = ("advert", "breadcrumb", "comment", "cookie", "newsletter", "sidebar", "sponsor")
# Words before which one of those describes a layout: has-sidebar, page-with-ads; and one that does so anywhere.
LAYOUT_WORDS = frozenset("has no with without".split())
LAYOUT = "layout"
# Those that may as well name a box around the whole page; an article element in it is an article.
BOX_WORDS = frozenset(
    "banner notice notices alert popup modal overlay widget promo promotion share sharing social signup login search skip".split()
)
# Those that also turn an article into something else.
NO_ARTICLE_WORDS = frozenset("ad advert comment comments reply replies related promo sponsored teaser".split())
# What holds the article: the first of these that a page has.
ARTICLE_SIGNS = (
    re.compile(r"<article[\s>]", re.IGNORECASE),
    re.compile(r"<main[\s>]|\brole\s*=\s*[\"']?main\b", re.IGNORECASE),
)
ARTICLE_WORDS = frozenset("article story post entry articlebody maincontent main content".split())
IN_HEAD = frozenset("head meta link base".split())
NOT_SHOWN = re.compile(r"(?:^|[;\s])display\s*:\s*none\b", re.IGNORECASE)
# Frequent words of four languages.
STOP_WORDS = frozenset(
    (
        "a about after all also an and are as at be been but by can could for from had has have he her his if in into is it "
        "its more not of on one or our she so some that the their them there they this to was we were what when which who "
        "will with would you "
        "au aux avec ce ces cette dans de des du elle en est et eux il je la le les leur lui ma mais me mes mon ne nos notre "
        "nous on ou par pas pour qu que qui sa se ses son sont sur ta te tes ton tu un une vos votre vous "
        "aber als am auch auf aus bei bin bis da das dass dem den der des die doch durch ein eine einem einen einer es "
        "für hat ich ihr im in ist ja kann mit nach nicht noch nur ob oder sich sie sind so um und uns von vor war was wenn "
        "wie wir zu zum zur "
        "al como con cuando del el ella ellos en entre era es esta este ha hay la las lo los más me mi muy no nos o otra "
        "para pero por que se ser si sin sobre su sus también te todo un una uno y ya"
    ).split()
)
MAX_LINK_SHARE = 0.2
# Inside an article running text may have more links, but not be little else.
MAX_ARTICLE_LINK_SHARE = 0.9
SHORT_CHARS, LONG_CHARS = 70, 200
STOP_LOW, STOP_HIGH = 0.30, 0.32
# Below this share in all its text a page is in another language.
FOREIGN = 0.08

TOKEN = re.compile(
    rf"(?P<text>[^<]+)|<!--.*?(?:-->|\Z)|<(?P<silent>{SILENT})(?=[\s/>])[^>]*(?<!/)>.*?(?:</(?P=silent)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>[^<>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^<>\"']*)*)>"
    r"|<[!?/][^>]*>|<(?P<odd>[a-zA-Z][^>]*>)?",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
ATTRIBUTE_HIDES = re.compile("hidden|display", re.IGNORECASE)
WORDS = re.compile(r"[^\W\d_]+")


BOXES = re.compile("|".join(sorted(BOX_WORDS)), re.IGNORECASE)


def _attributes(rest: str) -> dict[str, str]:
    """An element's attributes by name in small letters; of repeated ones the first counts."""
    found: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def _marks(attributes: dict[str, str]) -> list[list[str]]:
    """The words of each name in an element's class, id and role."""
    found = " ".join(attributes[x] for x in ("class", "id", "role") if x in attributes)
    return [re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower()) for x in found.split()]


def _aside_words(words: list[str]) -> list[str]:
    """The words of a name that say that its element is not the article."""
    if LAYOUT in words:
        return []
    found = []
    for word in words:
        if word in LAYOUT_WORDS:
            break
        if word in ASIDE_WORDS or word.startswith(ASIDE_STARTS):
            found.append(word)
    return found


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or bool(NOT_SHOWN.search(attributes.get("style", "")))


def _place(base: str, name: str, rest: str, sign: int, boxes: bool) -> str:
    """Where an element is, by where its parent is: in the article, aside of it, in a box, or neither.

    A box is aside, but for articles in it; without ``boxes`` it is like any other element.
    """
    if base == "aside" or name in ASIDE or (name == "header" and base != "article"):
        return "aside"
    attributes = _attributes(rest) if rest else {}
    if _hidden(attributes):
        return "aside"
    marks = _marks(attributes) if attributes else []
    article = (sign == 0 and name == "article") or (sign == 1 and (name == "main" or ["main"] in marks))
    if article or name in ("html", "body", "article", "main"):
        words = NO_ARTICLE_WORDS if name in ("article", "main") else frozenset()
        if any(words.intersection(x) for x in marks):
            return "aside"
        return "article" if article else base
    words = [w for x in marks for w in _aside_words(x)]
    if any(w not in BOX_WORDS for w in words):
        return "aside"
    if words and boxes:
        return "box"
    if sign == 2 and base != "box" and name in ("div", "section") and any(ARTICLE_WORDS.intersection(x) for x in marks):
        return "article"
    return base


class Block:
    __slots__ = ("text", "link_chars", "place", "article", "heading", "label")

    def __init__(self, text: str, link_chars: int, place: str, article: int, heading: bool):
        self.text, self.link_chars, self.place, self.article, self.heading = text, link_chars, place, article, heading
        self.label = self.decide()

    def link_share(self) -> float:
        return self.link_chars / len(self.text)

    def stop_share(self) -> float:
        words = WORDS.findall(self.text.lower())
        return sum(w in STOP_WORDS for w in words) / max(1, len(words))

    def aside(self) -> bool:
        return self.place in ("aside", "box")

    def decide(self, known: bool = True) -> str:
        """The first pass: good, bad, near or short; by length and links only where stop words aren't ``known``."""
        if self.aside() or self.link_share() > MAX_LINK_SHARE:
            return "bad"
        if len(self.text) < SHORT_CHARS:
            return "bad" if self.link_chars else "short"
        if not known:
            return "good" if len(self.text) > LONG_CHARS else "near"
        stops = self.stop_share()
        if stops >= STOP_HIGH:
            return "good" if len(self.text) > LONG_CHARS else "near"
        return "near" if stops >= STOP_LOW else "bad"

    def in_article(self) -> str:
        """The label inside an article that is borne out: good, bad or near."""
        if self.label == "good" or self.aside():
            return self.label
        links = self.link_share()
        if links > MAX_ARTICLE_LINK_SHARE or (links > MAX_LINK_SHARE and self.stop_share() < STOP_LOW):
            return "bad"
        return "near"


def _clean(parts: list[str]) -> str:
    text = "".join(parts)
    if "&" in text:
        text = html.unescape(text)
    return " ".join(text.split())


def blocks_of(page: str, sign: int, boxes: bool = True) -> list[Block]:
    """The non-empty blocks of a page with the label of the first pass.

    ``sign`` says what holds the article: 0 article elements, 1 the main element, 2 neither.
    """
    blocks: list[Block] = []
    parts: list[str] = []
    links: list[str] = []
    in_link = breaks = 0
    heading = False
    # Open elements that are no inline ones, each with the place it makes and the article it is in.
    stack: list[tuple[str, str, int]] = []
    place = ""
    article = articles = 0
    in_head = False
    # Open inline elements from the first one that isn't shown, and the number of others around them.
    unseen: list[str] = []
    around = 0

    def close() -> None:
        nonlocal links
        if parts:
            text = _clean(parts)
            if text:
                blocks.append(Block(text, len(_clean(links)) if links else 0, place, article, heading))
            parts.clear()
        links = []

    for token in TOKEN.finditer(page):
        kind = token.lastgroup
        if kind == "text":
            if not in_head and not unseen:
                parts.append(token["text"])
                if in_link:
                    links.append(token["text"])
                if breaks and not token["text"].isspace():
                    breaks = 0
            continue
        name = token["name"]
        if name is None:
            if token[0] == "<" and not in_head and not unseen:
                parts.append("<")
            continue
        name, end = name.lower(), bool(token["end"])
        if name in INLINE:
            rest = token["rest"]
            if unseen and end:
                while name in unseen and unseen.pop() != name:
                    pass
            elif not end and name not in VOID and not rest.endswith("/"):
                if unseen:
                    unseen.append(name)
                elif rest and ATTRIBUTE_HIDES.search(rest) and _hidden(_attributes(rest)):
                    unseen, around = [name], len(stack)
            if name == "a":
                in_link = 0 if end else 1
            elif name == "br" and not unseen:
                breaks += 1
                parts.append(" ")
                if breaks > 1:
                    close()
            continue
        close()
        breaks = 0
        # Links and headings don't go on in the next block.
        in_link = 0
        heading = name in HEADINGS and not end
        in_head = name in IN_HEAD and (in_head or name == "head") and not (name == "head" and end)
        if name in VOID or name in IN_HEAD or token["rest"].endswith("/"):
            continue
        if end:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    del stack[depth:]
                    break
            if len(stack) < around:
                unseen = []
            place, article = stack[-1][1:] if stack else ("", 0)
            continue
        # A paragraph ends where the next block begins, with or without its end tag.
        if stack and (stack[-1][0] == "p" or (stack[-1][0] == name and name in ("li", "dt", "dd", "option", "tr", "td"))):
            stack.pop()
        base, article = stack[-1][1:] if stack else ("", 0)
        place = _place(base, name, token["rest"], sign, boxes)
        if place == "article" and not article:
            articles += 1
            article = articles
        stack.append((name, place, article))
    close()
    if not in_known_language(blocks):
        for block in blocks:
            block.label = block.decide(known=False)
    return blocks


def in_known_language(blocks: list[Block]) -> bool:
    """Whether running text holds stop words at all; pages of other languages are judged without them."""
    text = [b for b in blocks if not b.aside() and len(b.text) >= SHORT_CHARS and b.link_share() <= MAX_LINK_SHARE]
    return not text or any(b.stop_share() >= FOREIGN for b in text)


def _inherit(labels: list[str], articles: list[int], open_label: str, decided: tuple[str, ...]) -> list[str]:
    """Each open block's nearest decided neighbours: good between good ones, else bad.

    The edges of an article are good, those of the page bad. "" is no neighbour.
    """

    def nearest(order: range) -> list[str]:
        found, last, article = [""] * len(labels), "bad", 0
        for i in order:
            if articles[i] != article:
                article = articles[i]
                last = "good" if article else last
            found[i] = last
            last = labels[i] if labels[i] in decided else last
        return found

    sides = list(zip(nearest(range(len(labels))), nearest(range(len(labels) - 1, -1, -1))))
    if open_label == "near":
        return ["bad" if x == "near" and y == ("bad", "bad") else "good" if x == "near" else x for x, y in zip(labels, sides)]
    return [
        ("good" if "good" in y and "bad" not in y else "bad") if x == open_label else x for x, y in zip(labels, sides)
    ]


def borne_out(blocks: list[Block]) -> set[int]:
    """The articles that hold a good block; all of them if the page has none."""
    good = [b for b in blocks if b.label == "good"]
    return {b.article for b in good or blocks if b.article}


def settle(blocks: list[Block]) -> list[str]:
    """The second pass: final labels, good or bad."""
    trusted = borne_out(blocks)
    articles = [b.article if b.article in trusted else 0 for b in blocks]
    labels = [b.in_article() if a else b.label for a, b in zip(articles, blocks)]
    # What is put into an article's text from aside says nothing of the blocks beside it.
    labels = ["" if a and b.aside() else x for x, a, b in zip(labels, articles, blocks)]
    # A heading belongs to the text below it.
    for i in range(len(blocks) - 2, -1, -1):
        if labels[i] == "short" and blocks[i].heading and labels[i + 1] in ("good", "near"):
            labels[i] = "near"
    labels = _inherit(labels, articles, "short", ("good", "near", "bad"))
    return _inherit(labels, articles, "near", ("good", "bad"))


def main_text(page: str | None) -> str:
    """The main text of a page, a line per block; empty if there is none."""
    if not page:
        return ""
    text = _text_of(page, True)
    # What looks like a box may be around all there is.
    return text or (_text_of(page, False) if BOXES.search(page) else "")


def _text_of(page: str, boxes: bool) -> str:
    # Article elements may hold comments or teasers only; then the next sign may do better.
    first: list[Block] | None = None
    for sign in (*(i for i, x in enumerate(ARTICLE_SIGNS) if x.search(page)), 2):
        blocks = blocks_of(page, sign, boxes)
        inside = [b for b in blocks if b.place == "article"]
        if any(b.label == "good" for b in inside):
            break
        if first is None and any(b.link_share() <= MAX_ARTICLE_LINK_SHARE for b in inside):
            first = blocks
    else:
        blocks = first or blocks
    return "\n".join(b.text for b, label in zip(blocks, settle(blocks)) if label == "good")


def extract_main_text(
    pages: DataFrame, *, page_id: str = "page_id", url: str = "url", content: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars) of each row, in one pass without a shuffle.

    Defined results: a null or empty page has an empty text; null and repeated ids or urls
    are passed on; markup that never ends is read to the end of the page; other columns
    are not read.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", SLICE_BYTES):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(texts, pa.string()),
                    pa.array([len(x) for x in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    chosen = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(content).alias("html")
    )
    return chosen.mapInArrow(rows, "page_id long, url string, text string, n_chars long")
