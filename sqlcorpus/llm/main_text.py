"""Main text of web pages by block rules in two passes.

A page is cut into blocks of text. Blocks that markup rules out (navigation, forms, side columns, adverts, reader
comments and the like) go first, and all that lies outside the article where a page names one. Pass
one looks at each other block alone: its length, the share of its letters in links, and the share of its
words that are stop words make it good, bad or leave it open. Pass two gives each open block the label of the
nearest decided one; headings look at what follows them. Around an article lies good, around a page bad.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sqlcorpus.llm.tables import quoted, without

SHORT = 70  # characters below which a block says too little
MOST_LINKED = 0.4  # share of a block's characters in links
MANY_STOPS, FEW_STOPS = 0.2, 0.05  # share of a block's words

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset("""
a about after all also an and are as at be because been but by can for from had has have he her his i if in into is it its more not of
on one or other our out she so that the their them there they this to was we were what when which who will with would you your
au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se ses son
sur un une vous
aber als am auch auf aus bei das dass dem den der die ein eine einem einen einer er es für hat ich im ist man mit nach nicht noch nur
oder sich sie sind so über um und von vor war werden wie wir wird zu zum zur
al como con del el ella entre era esta este ha hay las lo los más me mi muy no para pero por porque se sin sobre su sus te todo una y ya
""".split())

# Elements by what they do to text.
BLOCKS = frozenset("""
address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1
h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul
""".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())
HIDDEN = frozenset("audio button canvas datalist head math menu object option select svg template video".split())
APART = frozenset("aside dialog footer form header nav".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
ARTICLE, MAIN_NAMES = frozenset(("article", "main")), frozenset(("articlebody", "article-body", "entry-content", "post-content", "main-content"))
# Parts of class names and ids of what surrounds an article.
SURROUNDING = frozenset("""
ad ads advert advertisement adverts aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr
header masthead menu modal nav navbar navigation newsletter notice pagination paywall popup promo promoted recommended related reply
replies respond share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar topbar widget widgets
""".split())
NEGATIONS = frozenset(("has", "is", "no", "non", "with", "without"))
# A start of one of these ends an open element of the other kind on top of the stack.
ENDS_BY_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th")}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?)*+)>?"
    r"|</[^>]*+>?|[^<]++|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s\"']++)))?")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
WORD = re.compile(r"[^\W\d_]+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}


@dataclass
class Element:
    tag: str
    out: bool  # all in it is ruled out
    by_tag: bool  # ruled out by its tag alone, which an article in it overrides
    article: bool  # it lies in an article


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    article: int  # number of the article it lies in, 0 for none


@dataclass
class Page:
    """Blocks that markup leaves, in page order."""

    blocks: list[Block] = field(default_factory=list)
    stack: list[Element] = field(default_factory=list)
    open_tags: dict[str, int] = field(default_factory=dict)
    pieces: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    articles: int = 0
    link: bool = False
    breaks: int = 0

    def push(self, element: Element) -> None:
        self.stack.append(element)
        self.open_tags[element.tag] = self.open_tags.get(element.tag, 0) + 1

    def pop(self) -> Element:
        element = self.stack.pop()
        self.open_tags[element.tag] -= 1
        return element

    def end_block(self) -> None:
        if self.pieces:
            text = " ".join(unescape("".join(self.pieces)).split())
            if text:
                linked = len(" ".join(unescape("".join(self.linked)).split()))
                heading = any(self.open_tags.get(h) for h in HEADINGS)
                inside = bool(self.stack) and self.stack[-1].article
                self.blocks.append(Block(text, linked, heading, self.articles if inside else 0))
            self.pieces, self.linked = [], []
        self.breaks = 0

    def add(self, text: str) -> None:
        if self.stack and self.stack[-1].out:
            return
        if self.breaks > 1 and text.strip():
            self.end_block()
        elif text.strip():
            self.breaks = 0
        self.pieces.append(text)
        if self.link:
            self.linked.append(text)

    def start(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.breaks += 1
            self.pieces.append(" ")
            return
        if tag == "a":
            self.link = True
        if tag in BLOCKS:
            self.end_block()
            while self.stack and self.stack[-1].tag in ("p", "head"):
                self.pop()
            while self.stack and self.stack[-1].tag in ENDS_BY_ITSELF.get(tag, ()):
                self.pop()
            if tag in ("p", "li", "h1"):
                self.link = False  # a link that nobody closed
        if tag in VOID:
            return
        top = self.stack[-1] if self.stack else Element("", False, False, False)
        found = {m[1].lower(): next((v for v in m.groups()[1:] if v is not None), "") for m in ATTRIBUTE.finditer(attrs)} if attrs.strip() else {}
        names = f"{found.get('class', '')} {found.get('id', '')}".split()
        named = any(surrounds(n) for n in names) and tag not in ("html", "body", "main")
        hidden = tag in HIDDEN or "hidden" in found or found.get("role", "").lower() in ROLES or "display:none" in found.get("style", "").replace(" ", "").lower()
        body = tag in ARTICLE or found.get("role", "").lower() == "main" or found.get("itemprop", "").lower() == "articlebody" or any(
            n.lower() in MAIN_NAMES for n in names)
        if tag == "article" and named and not all(surrounds(n) for n in names):
            named = False
        apart = tag in APART and not (tag == "header" and top.article)
        out, by_tag = top.out, top.by_tag
        if body and not named and not hidden and top.out and top.by_tag:
            out = by_tag = False
        elif named or hidden:
            out, by_tag = True, False
        elif apart and not top.out:
            out, by_tag = True, True
        article = top.article
        if body and not out and not article:
            article = True
            self.articles += 1
        if tag in BLOCKS or tag in HIDDEN or out != top.out or article != top.article or self.open_tags.get(tag):
            self.push(Element(tag, out, by_tag, article))

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        if tag in BLOCKS:
            self.end_block()
        if self.open_tags.get(tag) and tag not in ("html", "body"):
            while self.pop().tag != tag:
                pass


def surrounds(name: str) -> bool:
    """Whether a class name or id is that of something around an article."""
    parts = [p.lower() for p in PART.findall(name)]
    return any(p in SURROUNDING for p in parts) and parts[0] not in NEGATIONS


def blocks_of(html: str) -> list[Block]:
    """The blocks of text that markup does not rule out."""
    page, at = Page(), 0
    while at < len(html):
        token = TOKEN.match(html, at)
        at = token.end()
        tag = token["tag"]
        if tag is None:
            if html[token.start()] != "<" or at - token.start() == 1:
                page.add(token[0])
            continue
        tag = tag.lower()
        if token["end"]:
            page.end(tag)
        elif tag in RAW:
            page.end_block() if tag in BLOCKS else None
            closing = RAW_END[tag].search(html, at)
            at = closing.start() if closing else len(html)
        else:
            page.start(tag, token["attrs"])
    page.end_block()
    if page.articles and any(b.article for b in page.blocks):
        return [b for b in page.blocks if b.article]
    return page.blocks


def first_pass(block: Block) -> bool | None:
    """Good, bad or open by the block alone."""
    words = WORD.findall(block.text.lower())
    if block.linked > MOST_LINKED * len(block.text):
        return False
    if not block.article and ("\N{COPYRIGHT SIGN}" in block.text or not words):
        return False
    stops = sum(w in STOP_WORDS for w in words)
    if not block.heading and len(block.text) >= SHORT:
        if stops >= MANY_STOPS * len(words) and words:
            return True
        if stops < FEW_STOPS * len(words) and not block.article:
            return False
    return None


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Open blocks take the label of the nearest decided one; of two as near, the good one in an article, else the bad one."""
    n = len(blocks)
    before: list[tuple[int, bool]] = []  # distance and label of the nearest decided block before each
    after: list[tuple[int, bool]] = []
    for out, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last, at, inside = None, 0, None
        for k in order:
            if inside != blocks[k].article:  # a border: of an article good, of the page bad
                last, at, inside = bool(blocks[k].article), k + (1 if out is after else -1), blocks[k].article
            out.append((abs(k - at), last))
            if labels[k] is not None:
                last, at = labels[k], k
    after.reverse()
    found = []
    for block, label, (back, left), (on, right) in zip(blocks, labels, before, after):
        if label is None:
            if block.heading:
                label = right
            elif back == on:
                label = (left or right) if block.article else (left and right)
            else:
                label = left if back < on else right
        found.append(label)
    return found


def main_text(html: str | None) -> str:
    if not html:
        return ""
    blocks = blocks_of(html)
    labels = second_pass(blocks, [first_pass(b) for b in blocks])
    return "\n".join(b.text for b, good in zip(blocks, labels) if good)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns with ``text`` (the main text, empty if there is none) and ``n_chars`` (its code points, long).

    Blocks are joined by one line end, white space inside a block is one blank, character references are
    decoded. A null or empty page has an empty text; broken and unclosed markup is read as far as
    it goes, and a page of any length as a whole, in time linear in it. Repeated rows come out alike; columns
    named ``text`` or ``n_chars`` give way; an empty table gives an empty one.
    """
    others = without(pages, ["text", "n_chars"])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(h) if isinstance(h, str) else "" for h in batch]
            yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    rows = pages.select(F.struct(*[F.col(quoted(c)) for c in others]).alias("row"), F.col(quoted(html)).alias("html"))
    made = F.pandas_udf(run, "text string, n_chars long")
    return rows.withColumn("v", made("html")).select("row.*", "v.*")
