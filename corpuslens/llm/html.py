"""Main-text extraction by two passes of block rules.

The markup is cut into blocks of text. The first pass decides a block that lies
in furniture, and any other by its own length, link density and stop-word
density; short blocks, and those whose signs disagree, stay open. A name of
furniture in a class or id is one sign among these within an article. The second
pass gives an open block the label of the nearest block that was decided by its
text, within the same article if it lies in one. On a page without an article
stop words count relative to the page's own blocks, so that its language and its
length set the measure. Time is linear in the page.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import tidy

#: Elements that end a block.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td "
    "textarea tfoot th thead title tr ul".split()
)
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg math iframe object embed canvas video audio head title textarea select button datalist map applet".split())
#: Elements around the page's furniture.
FURNITURE = frozenset("nav footer aside form dialog menu".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role values that name furniture which may be prose.
PROSE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising comment comments commentlist consent cookie cookies disclaimer disqus dialog gdpr modal newsletter "
    "notice notices popup popups promo promoted promotion promotions recommended related replies reply respond sidebar sidebars sponsor sponsored sponsors subscribe subscription signup alert".split()
)
#: Words that name other furniture.
NAMES = frozenset(
    "banner banners breadcrumb breadcrumbs copyright footer masthead menu menus nav navbar navigation navigator pagination pager search share sharing "
    "social toolbar topbar widget widgets complementary contentinfo toc login tags author bio byline".split()
)
#: Words that may stand beside such a word in one name; with any other word beside it, it names no furniture.
NEUTRAL = frozenset(
    "area article articles bar block body bottom box button buttons center col column container content fixed form global group header holder icons inner item items layer left "
    "link links list local main mobile news outer overlay page panel post posts primary right row section secondary site slot sticky story stories top unit wrap wrapper".split()
)
#: Words that name furniture only outside an article.
OUTER_NAMES = frozenset("header top bottom legal".split())
#: Frequent function words of the supported languages.
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you "
    "au aux avec ce ces dans de des du elle en est et il je la le les leur mais ne nous ou par pas pour qu que qui sa se ses son sont sur un une vous "
    "aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht noch nur oder sich sie sind so um und von vor war wie wir wird zu zum zur "
    "al como con del el ella ellos era eran esta este fue ha han las lo los más me mi muy no nos para pero por porque su sus también te tiene todo una uno y ya".split()
)
START = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
#: A tag. The first form stops at the next <, so failing costs no more than the way there; the others are tried once a tag.
TAGS = (
    re.compile(r"<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>"),
    re.compile(r"<(/?)([a-zA-Z][^\s/><]*)((?:[^>\"']|\"[^\"]{0,2000}+\"|'[^']{0,2000}+'){0,200}+)>"),
    re.compile(r"<(/?)([a-zA-Z][^\s/><]*)([^>]*)>"),
)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|style|aria-hidden|aria-label)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
SPACE = re.compile(r"\s+")
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "noscript", "iframe", "title")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IMPLIED = frozenset("p li dt dd tr td th option".split())


HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Elements that are text themselves: in an article a name on one is no sign.
TEXT_TAGS = HEADINGS | frozenset("p span a b i em strong small".split())
#: Elements on which a name is a sign at most.
CELL_TAGS = TEXT_TAGS | frozenset("li dd dt td th blockquote pre".split())
#: Kinds of a name: none, a sign, furniture that may be prose.
PLAIN, SIGN, PROSE = 0, 1, 2


def name_kind(value: str, in_article: bool) -> int:
    """What the whole words of a class, id or role value name.

    A token names furniture if all its words do or are neutral, so cookie-banner
    does and share-prices does not.
    """
    kind = PLAIN
    for token in value.lower().split():
        words = [w.rstrip("0123456789") for w in re.split("[-_]+", token) if w.strip("0123456789")]
        known = [w for w in words if w in PROSE_NAMES or w in NAMES or (not in_article and w in OUTER_NAMES)]
        if known and all(w in known or w in NEUTRAL for w in words):
            kind = max(kind, PROSE if any(w in PROSE_NAMES for w in known) else SIGN)
    return kind


def _marks(tag: str, attrs: str, in_article: bool) -> tuple[bool, int]:
    """(furniture by element or hidden, kind of name) of a start tag."""
    hard = tag in FURNITURE or (tag == "header" and not in_article)
    if not attrs or tag in ("html", "body", "main"):
        return hard, PLAIN
    kind = PLAIN
    for key, a, b, c in ATTRIBUTE.findall(attrs):
        key, value = key.lower(), a or b or c
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and HIDDEN.search(value.lower())):
            hard = True
        elif key in ("class", "id", "role", "aria-label"):
            kind = max(kind, name_kind(value, in_article))
    return hard, kind


class Block:
    """A block of text: its linked characters, whether it lies in furniture, the kind of name around it, its article's number (0 for none)."""

    __slots__ = ("text", "linked", "inside", "kind", "article", "heading", "label", "stops", "words")

    def __init__(self, text, linked, inside, kind, article, heading):
        self.text, self.linked, self.inside, self.kind, self.article, self.heading, self.label = text, linked, inside, kind, article, heading, None
        words = [w.strip(".,;:!?\"'()").lower() for w in text.split()]
        self.words, self.stops = len(words), sum(w in STOP_WORDS for w in words) / max(1, len(words))


class _Reader:
    """The open elements of a page and the text gathered for the present block."""

    def __init__(self):
        self.out, self.parts, self.linked, self.links = [], [], 0, 0
        self.stack: list = []  # (tag, hard, kind, silent, article number before)
        self.places: dict = {}  # of each open tag
        self.barriers: list = []  # places that an end tag of p doesn't reach through
        self.hard = self.silent = self.headings = self.article = self.articles = 0
        self.kinds = [0, 0, 0]

    def close_block(self) -> None:
        if self.parts:
            text = SPACE.sub(" ", entities.unescape("".join(self.parts))).strip()
            if text:
                kind = PROSE if self.kinds[PROSE] else SIGN if self.kinds[SIGN] else PLAIN
                self.out.append(Block(text, self.linked, self.hard > 0, kind, self.article, self.headings > 0))
        self.parts, self.linked = [], 0

    def push(self, tag, hard, kind, silent) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in ("article", "main", "body", "nav", "footer"):
            self.barriers.append(len(self.stack))
        self.stack.append((tag, hard, kind, silent, self.article))
        self.hard, self.silent, self.headings = self.hard + hard, self.silent + silent, self.headings + (tag in HEADINGS)
        self.kinds[kind] += 1
        if tag in ("article", "main"):
            self.articles += 1
            self.article = self.articles

    def pop(self) -> None:
        tag, hard, kind, silent, article = self.stack.pop()
        self.places[tag].pop()
        if self.barriers and self.barriers[-1] == len(self.stack):
            self.barriers.pop()
        self.hard, self.silent, self.headings = self.hard - hard, self.silent - silent, self.headings - (tag in HEADINGS)
        self.kinds[kind] -= 1
        self.article = article

    def end(self, tag) -> None:
        at = self.places.get(tag)
        if not at or tag in VOID or (tag == "p" and self.barriers and self.barriers[-1] > at[-1]):
            return
        for _ in range(len(self.stack) - at[-1]):
            self.pop()


def blocks(page: str) -> list:
    """The page's blocks of text, in order, with how many characters of each are links."""
    r, at, n = _Reader(), 0, len(page)
    last = page.rfind(">")
    while at < n:
        m = START.search(page, at)
        text = page[at:m.start()] if m else page[at:]
        if text and not r.silent:
            r.parts.append(text)
            if r.links:
                r.linked += len(text.strip())
        if not m:
            break
        at, kind = m.start(), m.group(0)
        if kind == "<!--":
            end = page.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if kind == "<![CDATA[":
            end = page.find("]]>", at)
            if not r.silent:
                r.parts.append(entities.escape(page[at + 9:n if end < 0 else end]))
            at = n if end < 0 else end + 3
            continue
        t = None
        if at < last:
            if kind in ("<!", "<?"):
                at = page.find(">", at) + 1
                continue
            for form in TAGS:
                t = form.match(page, at)
                if t:
                    break
        if t is None:  # a sign without a tag is text
            if not r.silent:
                r.parts.append(page[at])
            at += 1
            continue
        at, tag, attrs = t.end(), t.group(2).lower(), t.group(3)
        if tag in BLOCK_TAGS or tag in SILENT:
            r.close_block()
        elif tag == "br":
            r.parts.append(" ")
        if tag == "a":
            r.links = 0 if t.group(1) else 1
        if t.group(1):
            r.end(tag)
            continue
        if tag in RAW and not attrs.endswith("/"):
            end = RAW[tag].search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID or (attrs.endswith("/") and tag not in BLOCK_TAGS):
            continue
        if r.stack and r.stack[-1][0] == tag and tag in IMPLIED:
            r.pop()
        hard, name = _marks(tag, attrs, r.article > 0)
        name = PLAIN if tag in TEXT_TAGS and r.article else min(name, SIGN) if tag in CELL_TAGS else name
        silent = tag in SILENT
        if tag in BLOCK_TAGS or hard or silent or name:
            if (hard or name == PROSE) and not (tag in BLOCK_TAGS or silent):
                r.close_block()
            r.push(tag, int(hard), name, int(silent))
    r.close_block()
    return r.out


LONG, SHORT, LINKS, STOP_HIGH, STOP_LOW = 200, 70, 0.33, 0.32, 0.30


def by_text(b: Block) -> bool | None:
    """The label that a block's length, links and stop words give, or None."""
    size = len(b.text)
    if b.linked > LINKS * size:
        return False
    if size < SHORT:
        return False if b.linked else None
    if b.stops >= STOP_LOW:
        return True if b.stops >= STOP_HIGH or size > LONG else None
    return None if size > 3 * LONG else False


def by_page(b: Block, density: float) -> bool | None:
    """The label that a block's length and links, and its stop words beside the page's, give where no article is marked, or None."""
    size = len(b.text)
    if b.linked > LINKS * size:
        return False
    if size < SHORT:
        return False if b.linked else None
    return True if b.stops >= density / 2 else None


def decide(found: list) -> None:
    """Labels every block True (main text) or False, in two passes."""
    plain = [None if b.inside or b.kind == PROSE else by_text(b) for b in found]
    # Articles count as the place of the main text if most of the text that is so by itself stands in them.
    good = lambda inside: sum(len(b.text) for b, x in zip(found, plain) if not b.inside and b.kind != PROSE and (b.article > 0) == inside and x)
    marked = good(True) >= good(False) and any(b.article and not b.inside and b.kind != PROSE for b in found)
    free = [b for b in found if not b.inside and not b.kind and b.linked <= LINKS * len(b.text)]
    density = sum(b.stops * b.words for b in free) / max(1, sum(b.words for b in free))
    textual = [False] * len(found)  # decided by its text, not by where it stands
    for i, (b, x) in enumerate(zip(found, plain)):
        size = len(b.text)
        if b.inside or b.kind == PROSE:
            b.label = False
        elif marked and not b.article:  # beside the article only long prose without a sign against it stays open
            b.label = None if x and not b.kind and not b.linked and size > 3 * LONG else False
        elif marked or b.article:
            # In an article, a name needs a second sign, and few stop words alone are none.
            against = b.linked > LINKS * size or (b.kind and (size < SHORT or b.linked > 0.2 * size or b.stops < STOP_LOW))
            b.label = False if against and (b.kind or size >= SHORT) else True if x else None
            textual[i] = b.label is not None and not b.kind
        else:
            b.label = False if b.kind else by_page(b, density)
            textual[i] = b.label is not None and not b.kind
    _inherit(found, textual, marked)


def _inherit(found: list, textual: list, marked: bool) -> None:
    """Gives open blocks the label of the nearest decided one.

    In an article that is the nearest in it that its text decided; where the main
    text stands outside articles, the nearest that its text decided: furniture says
    nothing of its neighbours. Without any, an open block is main text if it stands
    where the main text does.
    """
    labels = [b.label for b in found]
    n = len(found)
    for inside in (True, False):
        before, last, seen = [None] * n, None, {}
        usable = lambda i: labels[i] is not None and (textual[i] if inside or not marked else True)
        for i, b in enumerate(found):
            if inside:
                before[i] = seen.get(b.article)
                if usable(i):
                    seen[b.article] = i
            else:
                before[i] = last
                last = i if usable(i) else last
        after, last, seen = [None] * n, None, {}
        for i in range(n - 1, -1, -1):
            b = found[i]
            if inside:
                after[i] = seen.get(b.article)
                if usable(i):
                    seen[b.article] = i
            else:
                after[i] = last
                last = i if usable(i) else last
        for i, b in enumerate(found):
            if labels[i] is not None or (b.article > 0) != inside:
                continue
            left, right = before[i], after[i]
            if left is None and right is None:
                b.label = inside == marked
            elif left is None or right is None:
                b.label = labels[right if left is None else left]
            elif b.heading or right - i < i - left:
                b.label = labels[right]
            elif i - left < right - i:
                b.label = labels[left]
            else:
                b.label = labels[left] or labels[right] if inside else labels[left] and labels[right]


def main_text(page: str | None) -> str:
    """The kept blocks in page order, joined by line feeds; empty for a null or empty page."""
    if not page:
        return ""
    found = blocks(page)
    decide(found)
    return "\n".join(b.text for b in found if b.label)


def extract(pages: DataFrame, id_col: str = "page_id", keep: tuple = ("url",), html_col: str = "html") -> DataFrame:
    """(id, kept columns, text, n_chars) of every row; null and empty pages give an empty text.

    Rows that repeat an id have a result each. A kept column named text or
    n_chars gives way to the result's.
    """
    keep = [c for c in keep if c not in ("text", "n_chars")]
    src = pages.select(id_col, *keep, F.col(html_col).cast("string").alias("_html"))
    fields = [StructField("text", StringType()), StructField("n_chars", LongType())]

    def run(batches):
        for b in batches:
            texts = [main_text(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*b.schema.names[:-1], "text", "n_chars"])

    return src.mapInArrow(tidy(run), StructType([*src.schema.fields[:-1], *fields]))
