"""Operator 5: main text of HTML pages by two-pass block rules.

A scanner that looks at each character once cuts the page into blocks. The first pass
judges each block by its length, the share of its text in links and the density of stop
words; what these leave open takes the label of the nearest blocks that they decide.
Names of elements and attributes are hints: they take navigation, forms, notices and
comments out, and where an article element holds most of what the rules accept, the
rules ask less of its blocks and the rest of the page is no article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    "the of and to in is it that for on with as are was be by at this from or an not have has but they which you we he she "
    "de la le les des et un une du en est que qui dans pour pas sur au avec par il elle ce se ne sont plus ou "
    "der die das und den von zu mit sich ist des im für nicht ein eine einer auf dem als auch es an werden aus er hat dass "
    "el los las que en y se del una por con para su al lo como más pero sus le ya o este sí porque".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var "
    "math mrow mi mn mo ms mtext mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mfenced mpadded semantics".split()
)
#: Elements that hold one block: their own name says little about it.
LEAF_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 pre figcaption".split())
#: How far an element's marks speak against its text: nothing, the name of a block, the name of a part of the page, the element itself.
FREE, HINTED, NAMED, NEVER = range(4)
#: Elements whose text never belongs to an article.
OUT_TAGS = frozenset("nav footer aside form button select option textarea menu dialog head title template".split())
#: Elements that count only outside an article.
OUTER_TAGS = frozenset(["header"])
MAIN_TAGS = frozenset(["article", "main"])
_OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|cookies?|consent|gdpr|"
    r"notice|alert|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|comments?|commentlist|respond|replies|reply|disqus|"
    r"share|sharing|social|related|recommended|newsletter|subscribe|signup|login|modal|popup|overlay|widget|toolbar|"
    r"pagination|pager|legal|copyright|disclaimer)(?:$|[\s_-])", re.I)
_OUTER_NAMES = re.compile(r"(?:^|[\s_-])(?:header|masthead|top|topbar)(?:$|[\s_-])", re.I)
_MAIN_NAMES = re.compile(r"(?:^|[\s_-])(?:article|post-?body|entry-?content|article-?body|story-?body|main-?content)(?:$|[\s_-])", re.I)
_HIDING_STYLE = re.compile(r"(?:^|[;\s])(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
#: Elements whose content is no text: skipped to their end tag, or to the page's end where browsers do so.
RAW = {t: re.compile(f"</{t}(?=[\\s/>])[^>]*>", re.I) for t in ("script", "style", "noscript", "svg", "iframe", "object", "canvas", "audio", "video", "annotation", "annotation-xml")}
_SWALLOWS = frozenset(["script", "style"])
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR_NAME = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*|=[^\s/>=]*)\s*(=?)\s*")
_BARE = re.compile(r"[^\s>]*")
_GAP = re.compile(r"[\s/]*")
_NOTED = frozenset(["class", "id", "role", "itemprop"])
_ENDS = frozenset(".!?:;…。！？।؟»”\"')")
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[^\W\d_]+")


class Block:
    __slots__ = ("code", "heading", "inside", "level", "linked", "text")

    def __init__(self, text: str, linked: int, level: int, inside: bool, heading: bool, code: bool):
        self.text, self.linked, self.level, self.inside, self.heading, self.code = text, linked, level, inside, heading, code

    @property
    def out(self) -> bool:
        """Whether it stands in a part of the page that its element or name sets apart."""
        return self.level >= NAMED


class Scanner:
    """Cuts a page into texts and tags in one pass: what was once looked for in vain is not looked for again."""

    def __init__(self, page: str):
        self.page, self.gone = page, set()

    def _find(self, what, at: int) -> int:
        """End of the next ``what`` (a string or a pattern) from ``at``, -1 for none."""
        if what in self.gone:
            return -1
        if isinstance(what, str):
            i = self.page.find(what, at)
            i = i + len(what) if i >= 0 else -1
        else:
            m = what.search(self.page, at)
            i = m.end() if m else -1
        if i < 0:
            self.gone.add(what)
        return i

    def _attributes(self, at: int) -> tuple[list[tuple[str, str]], bool, int]:
        """(names with values, whether a slash ends the tag, place after the tag; -1 for a tag without an end)."""
        page, found = self.page, []
        while True:
            gap = _GAP.match(page, at)
            if gap.end() >= len(page):
                return found, False, -1
            if page[gap.end()] == ">":
                return found, "/" in gap[0], gap.end() + 1
            m = _ATTR_NAME.match(page, at)
            at, value = m.end(), ""
            if m[2]:
                quote = page[at:at + 1]
                end = self._find(quote, at + 1) if quote in ("'", '"') else -1
                if end > 0:
                    value, at = page[at + 1:end - 1], end
                else:  # no quotes, or never closed
                    bare = _BARE.match(page, at)
                    value, at = bare[0], bare.end()
            found.append((m[1].lower(), value))

    def parts(self) -> Iterator[tuple]:
        """("text", text), ("open", tag, attributes, slash) and ("close", tag) in page order."""
        page, at, n = self.page, 0, len(self.page)
        while at < n:
            lt = page.find("<", at)
            if lt < 0:
                yield "text", page[at:]
                return
            if lt > at:
                yield "text", page[at:lt]
            if page.startswith("<!--", lt):
                end = self._find("-->", lt + 2)
                at = end if end > 0 else n
            elif page.startswith(("<!", "<?"), lt):
                end = self._find(">", lt)
                at = end if end > 0 else n
            else:
                close = page.startswith("/", lt + 1)
                name = _NAME.match(page, lt + 2 if close else lt + 1)
                if not name:
                    yield "text", "<"
                    at = lt + 1
                    continue
                attributes, slash, end = self._attributes(name.end())
                if end < 0:  # a tag that never ends shows nothing
                    return
                at, tag = end, name[0].lower()
                if close:
                    yield "close", tag
                elif tag in RAW:
                    if not (slash and tag == "svg"):
                        end = self._find(RAW[tag], at)
                        at = end if end > 0 else n if tag in _SWALLOWS else at
                else:
                    yield "open", tag, attributes, slash


def _hidden(attributes: list[tuple[str, str]]) -> bool:
    """The hidden attribute (but not until-found), aria-hidden with value true, or a style that hides."""
    for name, value in attributes:
        value = value.strip().lower()
        if name == "hidden" and not value.startswith("until"):
            return True
        if name == "aria-hidden" and value == "true" or name == "style" and _HIDING_STYLE.search(value):
            return True
    return False


def _marks(tag: str, attributes: list[tuple[str, str]]) -> tuple[int, bool, bool]:
    """(level, not article unless inside one, article)."""
    level, outer, main = NEVER if tag in OUT_TAGS else FREE, tag in OUTER_TAGS, tag in MAIN_TAGS
    if attributes and tag not in ("html", "body"):
        names = " ".join(v for k, v in attributes if k in _NOTED)
        if names:
            main = main or bool(_MAIN_NAMES.search(names))
            if not main and _OUT_NAMES.search(names):
                level = max(level, HINTED if tag in LEAF_TAGS else NAMED)
            outer = outer or bool(_OUTER_NAMES.search(names))
        if _hidden(attributes):
            level = NEVER
    return level, outer, main


class Builder:
    """Text blocks in page order. Unclosed elements end with their parent."""

    def __init__(self) -> None:
        self.found: list[Block] = []
        self.stack: list[tuple[str, int, bool]] = []  # tag, level, inside an article
        self.open: dict[str, int] = {}  # how many of a tag are open
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.link = -1  # depth at which a link was opened
        self.heading = self.code = self.inside = False
        self.level = FREE

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
            if text:
                linked = len(_SPACE.sub(" ", html.unescape("".join(self.linked))).strip())
                self.found.append(Block(text, linked, self.level, self.inside, self.heading, self.code))
            self.parts.clear()
            self.linked.clear()

    def text(self, piece: str) -> None:
        self.parts.append(piece)
        if self.link >= 0:
            self.linked.append(piece)

    def push(self, tag: str, level: int, inside: bool) -> None:
        self.stack.append((tag, level, inside))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.level, self.inside = level, inside

    def pop(self) -> None:
        self.open[self.stack.pop()[0]] -= 1
        self.level, self.inside = self.stack[-1][1:] if self.stack else (FREE, False)
        if self.link > len(self.stack):
            self.link = -1

    def opened(self, tag: str, attributes: list[tuple[str, str]], slash: bool) -> None:
        if tag == "br":
            self.text(" ")
        elif tag == "a":
            self.link = len(self.stack)
        elif tag in INLINE or tag in VOID and tag != "hr":
            if tag == "span" and _hidden(attributes):
                self.flush()
                self.push(tag, NEVER, self.inside)
        else:
            self.flush()
            if self.stack and self.stack[-1][0] in _CLOSED_BY_ANY or self.stack and self.stack[-1][0] == tag and tag in _CLOSED_BY_SAME:
                self.pop()
            self.heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            self.code = tag == "pre"
            level, outer, main = _marks(tag, attributes)
            level = max(self.level, level, NEVER if tag in OUTER_TAGS and not self.inside else NAMED if outer and not self.inside else FREE)
            if tag not in VOID and not slash:
                self.push(tag, level, self.inside or main and level < NAMED)

    def closed(self, tag: str) -> None:
        if tag == "a":
            self.link = -1
        elif tag in INLINE:
            if self.stack and self.stack[-1][0] == tag:
                self.flush()
                self.pop()
        elif tag not in VOID:
            self.flush()
            self.heading = self.code = False
            if self.open.get(tag):
                while self.stack[-1][0] != tag:
                    self.pop()
                self.pop()


_CLOSED_BY_ANY = frozenset("p h1 h2 h3 h4 h5 h6".split())
_CLOSED_BY_SAME = frozenset("li td th tr dt dd option".split())


def blocks(page: str) -> list[Block]:
    made = Builder()
    for part in Scanner(page).parts():
        if part[0] == "text":
            made.text(part[1])
        elif part[0] == "open":
            made.opened(*part[1:])
        else:
            made.closed(part[1])
    made.flush()
    return made.found


def decide(
    found: list[Block], short: int = 70, long: int = 200, low: float = 0.15, high: float = 0.3, links: float = 0.25, few: float = 0.1, bulk: float = 0.5,
) -> list[tuple[bool, str]]:
    """(article, the rule that says so) for each block, in two passes.

    First, by block: ``links`` (over ``links`` of the text is linked), ``density``
    (``short`` characters or more: many stop words and a length over ``long`` accept, few
    stop words reject, code left open), ``outside`` (elements that never hold article text,
    and parts of the page with such a name), ``named`` (blocks with such a name of their own
    that density doesn't accept). Where under ``few`` of a page's text stands in blocks with enough stop
    words, its language is taken for unknown, and ``length`` decides alone. Where the
    accepted text of article elements is at least ``bulk`` of all accepted text, or there is
    no other, they frame the page: other blocks go (``frame``), and inside blocks are not rejected for few stop
    words and may be linked up to 0.6. Names of parts count only while they leave a page
    its text: where nothing else is accepted and little else is open, they are set aside.
    Second, blocks still open take their nearest decided neighbours' label (``neighbours``);
    those outside or out of the frame tell nothing, headings take that of the block
    below, and labels (up to four words without a sentence end, out of an article) must stand between two accepted
    ones. Without any accepted block all open ones are accepted (``short page``).
    """
    def density(b: Block) -> float:
        words = _WORD.findall(b.text.lower())
        return sum(w in STOP_WORDS for w in words) / max(1, len(words))

    dense: dict[int, float] = {}
    known = total = 0
    for i, b in enumerate(found):
        if b.level < NEVER and len(b.text) >= short and b.linked <= 0.6 * len(b.text):
            dense[i] = density(b)
            if not b.out:
                known, total = known + len(b.text) * (dense[i] >= low), total + len(b.text)
    unknown = known < few * total

    def judged(i: int, b: Block, framed: bool, names: bool) -> tuple[bool | None, str]:
        n, inner = len(b.text), framed and b.inside
        away = b.level == NEVER or names and b.level == NAMED
        if framed and not b.inside and not away:
            return False, "frame"
        if b.linked > (0.6 if inner else links) * n or n < short and b.linked and not inner:
            return False, "links"
        if away:
            return False, "density" if not unknown and not b.code and dense.get(i, 1.0) < low else "outside"
        hinted = b.level == HINTED
        if n < short:
            return (False, "named") if hinted else (None, "")
        if unknown:
            return (True, "length") if n > long else (False, "named") if hinted else (None, "")
        if dense[i] >= (low if inner else high) and n > (short if inner else long):
            return True, "density"
        if hinted:
            return False, "named"
        return (None, "") if inner or b.code or dense[i] >= low else (False, "density")

    def labelled(names: bool) -> tuple[list[tuple[bool | None, str]], bool]:
        plain = [judged(i, b, False, names) for i, b in enumerate(found)]
        inside = sum(len(b.text) for i, b in enumerate(found) if b.inside and judged(i, b, True, names)[0])
        around = sum(len(b.text) for b, (good, _) in zip(found, plain, strict=True) if good and not b.inside)
        framed = any(b.inside and not b.out for b in found) and inside >= bulk * (inside + around)
        return ([judged(i, b, True, names) for i, b in enumerate(found)] if framed else plain), framed

    def away(i: int, b: Block) -> bool:
        return b.level == NEVER or label[i][1] in ("frame", "outside") or b.level == NAMED and names

    names, (label, framed) = True, labelled(True)
    if not any(good for good, _ in label) and not any(b.inside and not b.out for b in found):
        other, frame = labelled(False)
        gained = sum(len(b.text) for b, (good, _) in zip(found, other, strict=True) if good)
        if gained > 2 * sum(len(b.text) for b, (good, _) in zip(found, label, strict=True) if good is None):
            names, label, framed = False, other, frame
    if not any(good for good, _ in label):  # a page of short blocks only: the open ones are all there is
        return [(good is None, why or "short page") for good, why in label]
    n = len(label)
    before: list[tuple[int, bool] | None] = [None] * n
    after: list[tuple[int, bool] | None] = [None] * n
    for side, order in ((before, range(n)), (after, range(n - 1, -1, -1))):
        last = None
        for i in order:
            good = label[i][0]
            if good is not None and not away(i, found[i]):
                last = (i, good)
            side[i] = last
    decided = []
    for i, (good, why) in enumerate(label):
        a, b, block = before[i], after[i], found[i]
        if good is not None:
            decided.append((good, why))
        elif block.heading:
            decided.append((b[1] if b else framed, "neighbours"))
        elif not block.inside and len(block.text.split()) < 5 and block.text[-1] not in _ENDS and not block.code:
            decided.append((bool(a and b and a[1] and b[1]), "neighbours"))
        elif a and b:
            decided.append((a[1] if i - a[0] <= b[0] - i else b[1], "neighbours"))
        else:
            decided.append((bool((a or b) and (a or b)[1]), "neighbours"))
    return decided


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, (good, _) in zip(found, decide(found), strict=True) if good)


def extract(df: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """Adds ``out``: the article of each page, blocks joined by a newline; '' for none, NULL or empty html.

    Every column passes through unchanged except ``out``, which is replaced where the
    input has it. Rows are independent, so ties, repeats and empty tables need no rule.
    """
    short_batches(df.sparkSession)
    names = [c for c in df.columns if c != out]

    @F.pandas_udf("string")
    def text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in pages:
            yield s.map(main_text, na_action=None)

    return df.withColumn("__page", F.col(html_col)).select(*[F.col(f"`{c}`") for c in names], text("__page").alias(out))
