"""Main text of web pages: the best-scoring contiguous stretch of words and tags.

A page is read once, forward, as a sequence of words and tags. Words score by
the element that they stand in, by links, by the classes around them and by whether
prose without such classes follows and precedes; tags score negative. The weights
are log-odds learned from labelled pages, those whose own markup names the
article, over small stated priors for class names. One linear scan finds the
maximum-scoring subsequence, inside articles as well as outside. Elements that
are no text by HTML's own meaning (scripts, navigation, asides, forms, footers)
are not part of the sequence; a form around most of the page is a wrapper. Ids
and the classes of headings say nothing.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"(/?)([A-Za-z][A-Za-z0-9:-]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([A-Za-z-]++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++)))?")
SPACES = re.compile(r"\s+")
#: References to numbers beyond all characters.
HUGE_REFERENCE = re.compile(r"&#(?:0*+[1-9][0-9]{7,}|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{6,});?")
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "template", "iframe"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements and roles that by their own meaning are not the article.
HIDDEN = frozenset("head script style textarea title noscript template iframe svg canvas audio video select button form nav aside footer menu dialog input".split())
ROLES = frozenset("navigation banner search contentinfo complementary form dialog alertdialog alert menu menubar toolbar".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
INLINE = frozenset("a b i em strong span img br".split())
PLACES = frozenset("p li td th h1 h2 h3 h4 h5 h6 div span blockquote pre dd dt figcaption section body none".split())
#: Prior weights of a word by a class around it: adverts and reader comments, which no article is; notices and page furniture; and names that
#: parts of an article may have as well.
STRONG, NOTICE, WEAK = -4.5, -2.5, -1.8
PRIORS = {
    STRONG: "ad ads adv advert adverts advertisement advertising sponsor sponsored outbrain taboola comment comments commentlist replies disqus",
    NOTICE: "navbar navigation breadcrumb breadcrumbs sidebar sidenav footer masthead topbar respond newsletter subscribe cookie cookies consent gdpr notice notices popup modal pagination pager tagcloud disclaimer",
    WEAK: "nav menu header banner promo promotion reply share sharing social related recommended recommendations subscription signup login notification alert overlay widget toolbar tags skip search form aside",
}
MARKS = {name: weight for weight, names in PRIORS.items() for name in names.split()}
#: What a word under a notice's class loses besides where no other prose follows or precedes it, and one under any that stands in no paragraph.
EDGE, BARE = -1.0, -1.5
PARAGRAPHS = frozenset("p li td th h1 h2 h3 h4 h5 h6 blockquote pre dd dt figcaption".split())
#: Words that add nothing to a compound name: `ad-box` is `ad`, but `share-price` is not `share`.
FILLERS = frozenset("area bar blog block bottom box button buttons container content inner item items left links list main outer page panel post right section site slot top unit widget wrap wrapper global primary reader readers secondary user users visitor".split())
CONTENT_MARK = re.compile(r"\b(article-?body|post-?content|entry-?content|main-?content|story-?body)\b", re.I)
NAME_PART = re.compile(r"[a-z]+")
#: Pages that the weights are learned from, the first by hash of their id: the bound of the sample.
FIT_PAGES = 2_000
#: A class needs so many labelled pages before it weighs.
CLASS_PAGES = 5
#: Class names that weigh on a word, the innermost.
MOST_NAMES = 16
#: A class speaks for content on a page where it holds such a share of the article's words.
WRAPS = 1 / 3
BASE, PLACE_BOUND, CLASS_BOUND, LEAST_TAG, TAG_BOUND = 0.7, 1.5, 3.0, 0.05, 2.0
#: What a word gains inside, and loses outside, of the article where the page names one.
INSIDE, OUTSIDE = 2.0, -3.0


@dataclass
class Item:
    """A text run (words > 0 or blank) or a tag; `group` numbers blocks."""

    tag: str
    text: str
    words: int
    place: str
    link: bool
    hidden: bool
    article: bool
    group: int
    names: tuple[str, ...]


def unescape(text: str) -> str:
    return html.unescape(HUGE_REFERENCE.sub("�", text)) if "&" in text else text


class Reader:
    """Splits a page into text runs and tags, forward only: what is known to be missing ahead is never searched for again."""

    def __init__(self, page: str):
        self.page, self.missing, self.quotes = page, set(), True

    def find(self, what: str, start: int) -> int:
        at = -1 if what in self.missing else self.page.find(what, start)
        if at < 0:
            self.missing.add(what)
        return at

    def tag_end(self, start: int) -> int:
        """The place of the > that ends the tag; quoted ones don't, unless quotes never close."""
        at = start
        while self.quotes and (m := STOP.search(self.page, at)):
            if m[0] == ">":
                return m.start()
            closed = self.find(m[0], m.end())
            at = m.end() if closed < 0 else closed + 1
        self.quotes = False  # they swallow the rest of the page, so from here on they are plain characters
        return self.find(">", start)

    def pieces(self) -> Iterator[tuple[str, str, str]]:
        """("", text, "") or (name, with / if it ends, attributes)."""
        page, pos, at = self.page, 0, 0
        while (at := self.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end, after = at, self.find("-->", at + 4)
                after = len(page) if after < 0 else after + 3
            elif page.startswith("<![CDATA[", at) and (close := self.find("]]>", at + 9)) >= 0:
                yield "", page[pos:at], ""
                yield "", page[at + 9 : close], ""
                pos = at = close + 3
                continue
            elif page.startswith(("<!", "<?"), at) and (close := self.find(">", at)) >= 0:
                end, after = at, close + 1
            elif (m := NAME.match(page, at + 1)) and (close := self.tag_end(m.end())) >= 0:
                yield "", page[pos:at], ""
                yield m[1] + m[2].lower(), m[1], page[m.end() : close]
                pos = at = close + 1
                name = m[2].lower()
                if name in RAW and not m[1]:
                    found = re.compile(rf"</{name}\s*+>", re.I).search(page, pos)
                    pos = at = found.end() if found else len(page)
                continue
            else:
                at += 1
                continue
            yield "", page[pos:end], ""
            pos = at = after
        yield "", page[pos:], ""


def marks(attributes: str) -> tuple[tuple[str, ...], bool]:
    """The class names of a tag, and whether its attributes hide it."""
    names: list[str] = []
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "class":
            names += value.split()
        elif name == "hidden" or name == "role" and value in ROLES or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return tuple(names), True
    return tuple(names), False


def read_page(page: str) -> list[Item]:
    """The page's text runs and tags in order."""
    items: list[Item] = []
    forms: list[tuple[int, int]] = []  # the items of each outermost form
    began = 0
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, hides, opens an article, has names
    blocks: list[str] = []
    around: list[tuple[str, ...]] = [()]
    opened: Counter[str] = Counter()
    hidden = article = group = links = 0

    def close(tag: str) -> None:
        nonlocal hidden, article, links
        while True:
            name, hides, opens, named = stack.pop()
            opened[name] -= 1
            if name == "form" and not opened["form"]:
                forms.append((began, len(items)))
            hidden, article, links = hidden - hides, article - opens, links - (name == "a")
            if name in BLOCK:
                blocks.pop()
            if named:
                around.pop()
            if name == tag:
                return

    def add(tag: str, text: str) -> None:
        items.append(Item(tag, text, len(text.split()), blocks[-1] if blocks else "none", links > 0, hidden > 0, article > 0, group, around[-1]))

    for name, ends, attributes in Reader(page).pieces():
        if not name:
            if ends:
                add("", unescape(ends))
            continue
        tag = name.lstrip("/")
        group += tag in BLOCK
        if ends:
            if opened[tag]:
                close(tag)
        else:
            if tag in ("p", "li") and stack and stack[-1][0] == tag:
                close(tag)
            if tag == "br":
                add("", "\n")
            elif tag not in VOID and tag not in RAW and not attributes.endswith("/"):
                names, hides = marks(attributes) if attributes else ((), False)
                opens = tag in ("article", "main") or bool(attributes and CONTENT_MARK.search(attributes))
                hides = tag in HIDDEN or tag == "header" and not article or hides and tag not in ("html", "body", "article", "main")
                if tag == "form":
                    hides, began = False, began if opened["form"] else len(items)
                named = bool(names) and not opens and tag not in ("html", "body", *HEADINGS)
                stack.append((tag, hides, opens, named))
                opened[tag] += 1
                hidden, article, links = hidden + hides, article + opens, links + (tag == "a")
                if tag in BLOCK:
                    blocks.append(tag)
                if named:
                    around.append(tuple(dict.fromkeys(around[-1] + names))[-MOST_NAMES:])
        add(name, "")
    if opened["form"]:
        forms.append((began, len(items)))
    hide_forms(items, forms)
    return items


def hide_forms(items: list[Item], forms: list[tuple[int, int]]) -> None:
    """Forms are no text, but for one that holds most of the page's other words, which only wraps the page."""
    words = sum(x.words for x in items if not x.hidden)
    for start, end in forms:
        inside = items[start:end]
        if 2 * sum(x.words for x in inside if not x.hidden) <= words:
            for x in inside:
                x.hidden = True


@lru_cache(1 << 16)
def prior(name: str) -> float:
    """The prior weight of a class name: that of its words where no other word gives it another sense."""
    parts = [name] if name in MARKS else [p for p in NAME_PART.findall(name) if p not in FILLERS]
    return min(MARKS[p] for p in parts) if parts and all(p in MARKS for p in parts) else 0.0


def place_of(item: Item) -> str:
    return f"place:{item.place if item.place in PLACES else 'other'}|{int(item.link)}"


def tag_of(item: Item) -> str:
    name = item.tag.lstrip("/")
    return f"tag:{name if name in BLOCK or name in INLINE else 'other'}"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled pages, those with an article element, count what stands inside and outside of it."""
    for batch in batches:
        seen: Counter[tuple[str, bool]] = Counter()
        pages: Counter[tuple[str, bool]] = Counter()
        for page in batch.column("html").to_pylist():
            items = read_page(page)
            if not any(x.article for x in items):
                continue
            here: set[tuple[str, bool]] = set()
            held: Counter[str] = Counter()
            for x in items:
                content = x.article and not x.hidden
                if x.tag:
                    seen[tag_of(x), content] += 1
                elif x.words:
                    if not any(prior(k) for k in x.names) and not (x.hidden and (x.article or x.place not in PLACES)):  # what a name or an element tells already says nothing about its place
                        seen[place_of(x), content] += x.words
                    if content:
                        held.update(dict.fromkeys(x.names, x.words))
                    else:
                        here.update((f"class:{k}", False) for k in x.names)
            words = sum(x.words for x in items if x.article and not x.hidden)
            here.update((f"class:{k}", True) for k, n in held.items() if n >= WRAPS * words)
            pages.update(here)
        rows = [(k, c, n) for (k, c), n in (seen + pages).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.int64())], names=["name", "content", "n"])


Weights = dict[str, float]


def fit_weights(pages: DataFrame, limit: int = FIT_PAGES) -> Weights:
    """Log-odds of elements, tags and classes from at most `limit` labelled pages; tags stay negative, a class adds to its prior, for and against.

    A class speaks against what stands under it on every page where it stands
    outside of the article, and for it where it holds much of the article; a few
    words of the article under it say neither.
    """
    labelled = pages.where(F.col("html").rlike(r"(?i)<(article|main)\b") & F.col("page_id").isNotNull()).select("page_id", "html")
    chosen = labelled.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(limit).distinct()
    some = labelled.join(chosen, "page_id")
    counts = some.mapInArrow(_count, "name string, content boolean, n long").groupBy("name", "content").agg(F.sum("n").alias("n")).where(f"n >= {CLASS_PAGES} or name not like 'class:%'").collect()
    table = {(r["name"], r["content"]): r["n"] for r in counts}
    names = sorted({name for name, _ in table})
    total = {(k, c): sum(n for (name, content), n in table.items() if content == c and name.startswith(k)) for k in ("place", "tag") for c in (True, False)}
    out: Weights = {}
    for name in names:
        kind = name.split(":")[0]
        inside, outside = table.get((name, True), 0) + 1, table.get((name, False), 0) + 1
        if kind == "class":
            out[name] = max(-CLASS_BOUND, min(CLASS_BOUND, math.log(inside / outside)))
        else:
            odds = math.log(inside / (total[kind, True] + 2)) - math.log(outside / (total[kind, False] + 2))
            out[name] = max(-TAG_BOUND, min(-LEAST_TAG, odds - 0.5)) if kind == "tag" else max(-PLACE_BOUND, min(PLACE_BOUND, odds))
    return out


#: Where no page is labelled: plain words count for, links against.
PLAIN: Weights = {"place:p|0": 1.0, "tag:other": -0.5}
UNSEEN_LINK, UNSEEN_TAG = -1.5, -0.5


def against(names: tuple[str, ...], weights: Weights) -> float:
    """What the class takes from a word that speaks most against it."""
    return min((prior(k) + weights.get(f"class:{k}", 0.0) for k in names), default=0.0)


def word_scores(items: list[Item], weights: Weights) -> list[float]:
    """What each word of a text run scores: its element, its links, the classes around it and its place, and the article (0 for tags)."""
    names_article = any(x.article for x in items)
    taken = {names: min(0.0, against(names, weights)) for names in {x.names for x in items}}
    prose = [i for i, x in enumerate(items) if x.words and not x.link and taken[x.names] == 0 and (x.article or not names_article)]
    out = []
    for i, x in enumerate(items):
        loss = taken[x.names]
        if loss <= NOTICE and not (prose and prose[0] < i < prose[-1]):
            loss += EDGE
        if loss < 0 and x.place not in PARAGRAPHS:
            loss += BARE
        side = 0.0 if not names_article else INSIDE if x.article else OUTSIDE
        out.append(0.0 if x.tag else BASE + weights.get(place_of(x), UNSEEN_LINK if x.link else 0.0) + loss + side)
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """The maximum-scoring contiguous stretch [start, end), the first of equals; empty if nothing is positive."""
    best, now, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if now <= 0:
            now, start = 0.0, i
        now += s
        if now > best:
            best, found = now, (start, i + 1)
    return found


def extract(page: str, weights: Weights) -> str:
    """The blocks of the best region, without those that a class speaks against so much that their words score negative."""
    items = [x for x in read_page(page) if not x.hidden]
    own = [weights.get(tag_of(x), UNSEEN_TAG) if x.tag else x.words * score for x, score in zip(items, word_scores(items, weights), strict=True)]
    of_block: dict[int, float] = {}
    for x, s in zip(items, own, strict=True):
        if x.words and x.names:
            of_block[x.group] = of_block.get(x.group, 0.0) + s
    cut = {g for g, s in of_block.items() if s < 0}
    start, end = best_region([0.0 if x.group in cut and not x.tag else s for x, s in zip(items, own, strict=True)])
    blocks: dict[int, list[str]] = {}
    for x in items[start:end]:
        if not x.tag and x.group not in cut:
            blocks.setdefault(x.group, []).append(x.text)
    lines = (SPACES.sub(" ", "".join(b)).strip() for b in blocks.values())
    return "\n".join(line for line in lines if line)


def _extract(batches: Iterator[pa.RecordBatch], weights: Weights) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [extract(page, weights) for page in batch.column("_html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url and the main text of every page.

    Blocks are joined by one \\\\n in page order, white space inside a block is
    one space, character references are decoded. Blocks inside the region stay
    whatever they score, unless a class around them makes their words negative:
    adverts and reader comments inside an article go so, and notices in bare
    elements at its edges, while prose paragraphs of an article stay under any
    other name. Ids and headings' classes say nothing. Defined results: null and empty html
    give an empty text, as do pages without a positive region; unclosed elements
    end with the page, an unclosed comment hides the rest, quotes that never
    close are plain characters, a < without a > ahead is text; null ids and
    repeated rows give one row each; other columns are ignored; an empty table
    gives an empty result. Time is linear in the page, however malformed. Without
    labelled pages plain weights are used.
    """
    weights = weights if weights is not None else fit_weights(pages) or PLAIN
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("_html"))
    return rows.mapInArrow(partial(_extract, weights=weights), "page_id long, url string, text string")
