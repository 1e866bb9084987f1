"""Main text of web pages by two passes over text blocks.

The page is cut into blocks at block-level tags, with what the markup itself names as not the article left out (menus,
headers, footers, asides, forms, scripts, adverts, notices, comments; by element, role or class).
Pass 1 decides every block by its density of stop words, its length and the share of its characters in links. Inside
an <article> or <main> the thresholds are lower. Stop words can't tell where a page's text blocks together have hardly
any, or a block's letters are mostly not Latin: there, length and links alone decide. Pass 2 gives each undecided
(short or middling) block the label of its nearest decided neighbours on its side of the <article>'s border; a heading
goes with what it heads.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words.
STOP_WORDS = {
    "en": frozenset("the of and to a in is it that was for on with as at be by this from or an are not have his they which you he had but we all were when there can".split()),
    "de": frozenset("der die das und in zu den ist von mit für auf im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei sich des".split()),
    "fr": frozenset("le la les de des du et un une en est que qui pour dans pas sur au avec il elle ce par plus ne se son sont mais ou aux cette".split()),
    "es": frozenset("el la los las de del y un una en que es por con para se no lo su al como más pero sus le ya o este sí porque esta entre".split()),
}
SHORT, LONG, LINKS, ARTICLE_LINKS, STOP_LOW, ARTICLE_STOP_LOW, STOP_HIGH, HEADING_REACH = 70, 200, 0.3, 0.66, 0.12, 0.05, 0.22, 200
_LANGUAGES = {w: [k for k, own in STOP_WORDS.items() if w in own] for w in frozenset().union(*STOP_WORDS.values())}
_WORD = re.compile(r"[^\W\d_]+")
_NOT_LATIN = re.compile(r"[^\W\d_\x00-\u024f\u1e00-\u1eff]+")
#: Characters that say about as much as two of an alphabet.
_WIDE = re.compile(r"[\u2e80-\ua4cf\uac00-\ud7a3\uf900-\ufaff\uff00-\uff60\U00020000-\U0003ffff]+")

_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*"|'[^']*')*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|title|textarea|noscript|iframe|noembed|noframes|xmp)\b(?:{_ATTRIBUTES}>|[^>]*>).*?(?:</\1\s*>|\Z)"
    rf"|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES}(?=>)|[^>]*)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([\w:-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: A name that begins so says something about the page around it, or that something isn't there.
_AROUND = frozenset("has have no not non without with is js show hide before after page body layout".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NOT_ARTICLE = frozenset("head nav footer aside form script style noscript template svg math button select option object canvas audio video dialog menu fieldset datalist iframe map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
_CLASSES = frozenset(
    "nav navbar navigation menu submenu sidebar footer header masthead topbar banner cookie cookies consent gdpr notice notices notification notifications alert ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager subscribe subscription newsletter signup login popup modal overlay widget widgets toolbar copyright disclaimer".split()
)
#: Classes of <article> elements that aren't the article.
_NOT_ARTICLES = frozenset("comment comments reply related sponsored ad advert teaser".split())
_OWN_HEADER, _HEADER = frozenset("article post entry content page story title".split()), frozenset({"header", "masthead"})
#: An open element of the first is closed by the start of one of the second, unless a boundary lies between.
_CLOSED_BY = {"p": _BLOCK, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
_BOUNDARY = {"p": frozenset("td th li blockquote div section article button object".split()), "li": frozenset({"ul", "ol", "menu"}), "dd": frozenset({"dl"}), "dt": frozenset({"dl"}), "tr": frozenset({"table"}), "td": frozenset({"table"}), "th": frozenset({"table"}), "option": frozenset({"select"}), "head": frozenset()}


def _named(value: str) -> set[str]:
    """Which names of what isn't the article a class or id attribute has: a whole name, or its first or last part."""
    out = set()
    for name in value.split():
        parts = [x.lower() for x in _NAME_PART.findall(name)]
        if parts and parts[0] not in _AROUND:
            out |= {name.lower(), parts[0], parts[-1]} & _CLASSES
    return out


def _left_out(tag: str, attributes: str, in_article: bool, names: bool = True) -> bool:
    if tag in _NOT_ARTICLE or (tag == "header" and not in_article):
        return True
    if not attributes or attributes.isspace() or tag in ("html", "body", "main"):
        return False
    if tag == "article":
        return any(m[1].lower() == "class" and not _NOT_ARTICLES.isdisjoint((m[2] or "").strip("\"'").lower().split()) for m in _ATTRIBUTE.finditer(attributes))
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id"):
            if not names:
                continue
            found = _named(value)
            if found and found <= _HEADER and (in_article or {x.lower() for x in _NAME_PART.findall(value)} & _OWN_HEADER):
                found = frozenset()
            if found:
                return True
        elif name == "role" and value.lower() in _ROLES:
            return True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            return True
    return False


class Block:
    """Text of one block, its share of characters in links, whether it is in an article, a heading or a <pre>, its length, words and stop words by language."""

    __slots__ = ("counts", "heading", "in_article", "links", "pre", "size", "text", "told", "words")

    def __init__(self, text: str, linked: int, in_article: bool, heading: bool, pre: bool):
        self.text, self.in_article, self.heading, self.pre = text, in_article, heading, pre
        self.links = linked / max(1, len(text.replace(" ", "")))
        self.size, self.told = len(text), True
        words = _WORD.findall(text.lower())
        self.words, self.counts = len(words), Counter(k for w in words if w in _LANGUAGES for k in _LANGUAGES[w])
        if not text.isascii() and (other := sum(map(len, _NOT_LATIN.findall(text)))):
            self.size += sum(map(len, _WIDE.findall(text)))
            self.told = 2 * other <= sum(map(len, words))

    def density(self) -> float:
        """The largest share of words that are one language's stop words."""
        return max(self.counts.values(), default=0) / max(1, self.words)

    def stands(self) -> bool:
        """Whether a middling block is text even between blocks that aren't."""
        return self.size >= SHORT and (self.density() >= STOP_HIGH if self.told else not self.links)


def blocks(page: str, names: bool = True) -> list[Block]:
    """The page's text blocks in order, without those that the markup names as something else (by class and id: ``names``)."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # tag, left out, in article, in link, in <pre>
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    out_now = article = link = pre = False
    heading = False
    breaks = 0

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join(p for p, _ in parts).split())
            if text:
                linked = sum(len("".join(p.split())) for p, in_link in parts if in_link)
                out.append(Block(text, linked, article, heading, pre))
            parts = []

    def settle() -> None:
        nonlocal out_now, article, link, pre
        _, out_now, article, link, pre = stack[-1] if stack else ("", False, False, False, False)

    def close(tag: str, unless: frozenset[str] = frozenset()) -> None:
        """Close the innermost element of a tag and all in it, unless one of others is open in it."""
        at = places.get(tag)
        if at and not any(own[-1] > at[-1] for own in map(places.get, unless) if own):
            i = at[-1]
            for k in range(len(stack) - 1, i - 1, -1):
                places[stack[k][0]].pop()
            del stack[i:]
            settle()

    done = 0
    for m in _TOKEN.finditer(page):
        if m.start() > done and not out_now:
            piece = page[done : m.start()]
            if not piece.isspace():
                breaks = 0
            parts.append((html.unescape(piece), link))
        done = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            breaks += 1
            if breaks > 1:
                flush()
            elif not out_now:
                parts.append((" ", link))
            continue
        if tag in _BLOCK:
            flush()
        if m[2]:
            close(tag)
            if tag in _HEADINGS:
                heading = False
            continue
        for open_, closers in _CLOSED_BY.items():
            if tag in closers:
                close(open_, _BOUNDARY[open_])
        if tag in _VOID or m[4].endswith("/"):
            if tag == "img":
                parts.append((" ", link))
            continue
        if tag in ("article", "main"):
            article = True
        elif tag in _BLOCK and not article and "articleBody" in m[4]:
            article = True
        out_now = out_now or _left_out(tag, m[4], article, names)
        link = link or tag == "a"
        pre = pre or tag == "pre"
        heading = tag in _HEADINGS if tag in _BLOCK else heading
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, out_now, article, link, pre))
    if done < len(page) and not out_now:
        parts.append((html.unescape(page[done:]), link))
    flush()
    return out


def weigh(found: list[Block]) -> None:
    """Notes which blocks stop words can't tell about: all of a page whose text blocks hardly have any known ones."""
    texts = [b for b in found if b.told and b.size >= SHORT and b.links <= (ARTICLE_LINKS if b.in_article else LINKS)]
    counts = sum((b.counts for b in texts), Counter())
    if max(counts.values(), default=0) < STOP_LOW * sum(b.words for b in texts):
        for b in found:
            b.told = False


def decide(b: Block) -> str:
    """Pass 1: good, bad, near (probably text) or short (too short to tell)."""
    if b.links > (ARTICLE_LINKS if b.in_article else LINKS) or (not b.in_article and b.size < SHORT and "©" in b.text):
        return "bad"
    if b.size < SHORT:
        return "near" if b.in_article else "bad" if b.links else "short"
    if not b.told:
        return "good" if b.in_article or b.size >= LONG else "near"
    density = b.density()
    if b.in_article:
        # A short text, a heading or a program may do without stop words.
        return "good" if density >= STOP_LOW or b.size >= LONG and density >= ARTICLE_STOP_LOW else "near" if b.size < LONG or b.heading or b.pre else "bad"
    if density >= STOP_HIGH:
        return "good" if b.size >= LONG else "near"
    return "near" if density >= STOP_LOW else "bad"


def labels_of(found: list[Block]) -> tuple[list[str], list[str]]:
    """What pass 1 says of each block, and what both passes do: good or bad."""
    weigh(found)
    first = [decide(b) for b in found]
    n = len(found)
    before, after = [None] * n, [None] * n
    for order, to in ((range(n), before), (range(n - 1, -1, -1), after)):
        last = {True: None, False: None}
        for i in order:
            side = found[i].in_article
            to[i] = last[side]
            if first[i] in ("good", "bad"):
                last[side] = i
    labels = []
    for i, b in enumerate(found):
        label = first[i]
        if label in ("near", "short"):
            p, q = before[i], after[i]
            sides = [(i - p, first[p])] if p is not None else []
            sides += [(q - i, first[q])] if q is not None else []
            if b.heading and not b.in_article:
                label = "good" if q is not None and first[q] == "good" and sum(len(x.text) for x in found[i + 1 : q]) <= HEADING_REACH else "bad"
            elif not sides:
                label = "good" if label == "near" else "bad"
            elif len({s for _, s in sides}) == 1:
                # Between bad blocks, a middling block stands for itself; a short one goes. In an article, it takes bad ones on both sides.
                label = "good" if sides[0][1] == "good" or (label == "near" and (b.stands() or b.in_article and len(sides) == 1)) else "bad"
            else:
                nearest = min(sides)
                label = "good" if label == "near" or nearest[1] == "good" and sides[0][0] != sides[1][0] else "bad"
        labels.append(label)
    # An article's heading goes with the next block of the article; the last one stays.
    heads = "good"
    for i in range(n - 1, -1, -1):
        if found[i].in_article:
            if found[i].heading and first[i] == "near":
                labels[i] = heads
            heads = labels[i]
    return first, labels


def main_blocks(page: str) -> list[str]:
    """The texts of the blocks that both passes take for the article. Where class and id names leave nothing, as when
    a wrapper of the whole page has one of them, they don't count."""
    for names in (True, False):
        found = blocks(page, names)
        own = [b.text for b, label in zip(found, labels_of(found)[1], strict=True) if label == "good"]
        if own:
            return own
    return []


def extract(page: str | None) -> str:
    """Main text: block texts joined by newlines; empty for null, empty or text-free pages."""
    return "\n".join(main_blocks(page)) if page else ""


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(x.as_py()) for x in batch.column("html")]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) for each row of ``pages`` (page_id, url, html); the whole html is read.

    Null and empty html give an empty text; repeated rows each get a row; other columns are ignored; an empty table
    gives no rows. Inside a block white space, no-break spaces included, becomes one space. A page of any length costs
    time in proportion to it, whatever its tags are.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_rows, "page_id long, url string, text string, n_chars long")
