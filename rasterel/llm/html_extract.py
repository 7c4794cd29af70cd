"""HTML extraction (operator 6) as a maximum-scoring subsequence.

A page is a sequence of tags and words. Weights are learned from labelled pages, as log ratios of how
often something stands inside and outside the content: of tags, of elements by their tag, of the
values of class, id and role, and of the parts of such values. The evidence about an element is the
sum over its features; its words score positive if that of no element around them speaks for
boilerplate, else negative, and tags score negative. A linear scan finds the contiguous stretch with the
largest sum. Words that score negative within it (an advert between paragraphs, the readers'
comments at the end) are left out, and what remains is cut into blocks.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only_cache
from .labelled_pages import labelled_pages

_ITEM = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|(?P<text>[^<]+|<)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[^a-z0-9]+")

#: Elements whose content is no text of the page: skipped unparsed up to their end tag.
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video select".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that can hold other blocks; what their attributes say counts.
HOLDS = frozenset("article aside body center dd details dialog div dl fieldset figure footer form header html li main menu nav ol p section table td tr ul".split())
#: Elements made to hold content.
WHOLE = frozenset(("article", "main"))
#: Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main"
    " menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the first kind ends an open element of the second, unless one of the third is between.
_P_ENDS = BLOCK - {"body", "html"}
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


#: Text that no reader sees.
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
@functools.cache
def _end_of(tag: str) -> re.Pattern:
    """The end tag of an element whose content is skipped."""
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I)


#: The evidence of an element that isn't shown.
NOT_SHOWN = -100.0


def features(tag: str, rest: str, article: bool) -> list[str] | None:
    """What is known of an element: its tag, within or outside of articles, whole values of class, id and role, and their parts. None: not shown."""
    found = ["<" + tag + "@" * article]
    kind = "p" * (tag == "p")  # what marks a box needn't mark a paragraph
    if not rest or not rest.strip(" \t\r\n/"):
        return found
    for name, *values in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), next(filter(None, values), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and _HIDDEN.search(value):
            return None
        if name in ("class", "id", "role") and tag in HOLDS:
            for whole in value.split():
                parts = [p for p in _PART.split(whole) if p]
                found.append(kind + "=" + "-".join(parts))
                if len(parts) > 1 and not kind:
                    found += ["~" + p for p in parts]
    return found


class Weights:
    """Log ratios by feature, and the scores of words (plain, in links, beside articles, in boilerplate) and tags."""

    def __init__(self, ratios: dict[str, float], word: float, link: float, beside: float, aside: float, tags: dict[str, float]):
        self.ratios, self.word, self.link, self.beside, self.aside, self.tags = ratios, word, link, beside, aside, tags
        self.known: dict[tuple[str, str, bool], float] = {}

    def element(self, tag: str, rest: str, article: bool = False) -> float:
        """The evidence that an element (with an article around it) is content (positive) or boilerplate (negative)."""
        key = (tag, rest, article)
        score = self.known.get(key)
        if score is None:
            found = features(tag, rest, article)
            score = NOT_SHOWN if found is None else self.evidence(found)
            if len(self.known) < KNOWN:
                self.known[key] = score
        return score

    def evidence(self, found: list[str]) -> float:
        """The tag's ratio plus that of the most telling value; a value known as a whole speaks before its parts.

        Parts speak if none of them is unknown: a word that no labelled page has in such a place makes the value new.
        """
        tag, values, at = self.ratios.get(found[0], 0.0), [], 1
        while at < len(found):
            end = at + 1
            while end < len(found) and found[end][0] == "~":
                end += 1
            if found[at] in self.ratios:
                values.append(self.ratios[found[at]])
            elif end > at + 1 and all(p in self.ratios or p[1:].isdigit() for p in found[at + 1 : end]):
                values.append(sum(self.ratios.get(p, 0.0) for p in found[at + 1 : end]))
            at = end
        return tag + (min(values) if values else 0.0)


def items(page: str) -> Iterator[tuple[str, str, int, bool]]:
    """(tag or "", text or attributes, elements open around it, whether it opens one) in page order.

    Text items have an empty tag and decoded text; "br" and block boundaries are tags. End tags
    begin with "/". Unclosed elements end where HTML ends them or with their parent. The places of open elements are
    kept by tag, so that no tag needs a look through all of them: the time is linear in the page.
    """
    stack: list[str] = []
    places: dict[str, list[int]] = defaultdict(list)
    blocks: list[int] = []  # places of open block elements other than p

    def cut(k: int) -> None:
        for tag in stack[k:]:
            places[tag].pop()
        while blocks and blocks[-1] >= k:
            blocks.pop()
        del stack[k:]

    def last(tags) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=-1)

    at, size = 0, len(page)
    while at < size:
        m = _ITEM.match(page, at)
        at = m.end()
        text = m["text"] if m["text"] is not None else m["cdata"]
        if text is not None:
            yield "", entities.unescape(text) if "&" in text and m["cdata"] is None else text, len(stack), False
            continue
        if m["tag"] is None:
            continue
        tag, rest = m["tag"].lower(), m["rest"]
        if m["close"]:
            if places[tag]:
                cut(places[tag][-1])
                yield "/" + tag, "", len(stack), False
            elif tag in BLOCK:
                yield "/" + tag, "", len(stack), False
            continue
        if tag in RAW:
            if not rest.endswith("/"):
                end = _end_of(tag).search(page, at)
                at = end.end() if end else size
            continue
        ends, bounds = _ENDS.get(tag, ((), ()))
        if ends:
            k = last(ends | {"p"})
            if k > last(bounds):
                cut(k)
        elif tag in _P_ENDS and places["p"] and places["p"][-1] > (blocks[-1] if blocks else -1):
            cut(places["p"][-1])
        opens = tag not in VOID and not rest.endswith("/")
        yield tag, rest, len(stack), opens
        if opens:
            places[tag].append(len(stack))
            if tag in BLOCK and tag != "p":
                blocks.append(len(stack))
            stack.append(tag)


def _told(page: str) -> list[tuple[str, str, int, bool, bool, bool]]:
    """``items`` of a labelled page, each with whether an article is around it, and its label; labels are no attributes."""
    labels: list[bool] = []
    articles: list[bool] = []
    out = []
    for tag, text, depth, opens in items(page):
        del labels[depth:], articles[depth:]
        label, article = bool(labels) and labels[-1], bool(articles) and articles[-1]
        if opens:
            label = ("data-main" in text or label) and "data-aside" not in text
            labels.append(label)
            articles.append(article or tag in WHOLE)
            text = re.sub(r"\s*data-(?:main|aside)\b", "", text)
        out.append((tag, text, depth, opens, article, label))
    return out


def learn(pages: list[str]) -> Weights:
    """Weights from pages whose content is in elements marked data-main, less those marked data-aside in it.

    An element is content if it is so labelled; one around content (the page's body, say) is neither.
    """
    inside, outside, tags_in, tags_out, words = Counter(), Counter(), Counter(), Counter(), Counter()
    for page in pages:
        found = _told(page)
        around, holds = [], [False] * len(found)
        for i, (tag, _, depth, opens, _, label) in enumerate(found):
            del around[depth:]
            if label:
                for k in around:
                    holds[k] = True
            if opens:
                around.append(i)
        whole = _articles_hold((len(x.split()), a) for t, x, _, _, a, _ in found if not t)
        link = 0
        for i, (tag, text, _, opens, article, label) in enumerate(found):
            if not tag:
                words["link" if link else "beside" if whole and not article else "word", label] += len(text.split())
                continue
            link = link + 1 if tag == "a" else max(0, link - (tag == "/a"))
            (tags_in if label else tags_out)[tag] += 1
            if tag[0] != "/" and (label or not holds[i]):
                own = features(tag, text, article) or []
                for f in set(own[len(own) > 1 :]):  # a tag speaks for itself where no value does
                    (inside if label else outside)[f] += 1
    ratio = lambda a, b: math.log((a + 0.5) / (b + 0.5))
    # A tag that content has as well says nothing about an element.
    ratios = {f: 0.0 if f[0] == "<" and inside[f] else ratio(inside[f], outside[f]) for f in inside | outside}
    total_in, total_out = sum(tags_in.values()), sum(tags_out.values())
    tags = {t: min(math.log((tags_in[t] + 0.5) / (total_in + 1)) - math.log((tags_out[t] + 0.5) / (total_out + 1)), -0.1) / 200 for t in tags_in | tags_out}
    weight = {k: ratio(words[k, True], words[k, False]) for k in ("word", "link", "beside")}
    word = max(weight["word"], 0.5)
    return Weights(ratios, word, max(weight["link"], word / 8), min(max(weight["beside"], -word / 4), -word / 16), -word / 32, tags)


def _articles_hold(texts: Iterator[tuple[int, bool]]) -> bool:
    """Whether articles hold at least half of the words of (number of words, whether an article is around them)."""
    n = [0, 0]
    for words, article in texts:
        n[article] += words
    return n[1] > 0 and n[1] >= n[0]


#: For tags that no labelled page has; elements whose evidence a task remembers.
UNSEEN, KNOWN = -0.001, 10_000
#: Evidence below which an element is boilerplate.
BOILERPLATE = -1.0


@functools.cache
def weights_of_labelled() -> Weights:
    return learn(labelled_pages())


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """[begin, end) with the largest sum, the first and shortest of equals; empty if no score is positive."""
    best, best_at, total, begin = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, best_at = total, (begin, i + 1)
    return best_at


def scored(page: str, weights: Weights) -> list[tuple[str, str, bool, float]]:
    """(tag or "", text, whether it is no content, score) of each item in page order."""
    found, link = [], 0
    state: list[tuple[bool, bool, bool]] = []  # for each open element: it or one around it is boilerplate; is an article; is told to be content
    for tag, text, depth, opens in items(page):
        del state[depth:]
        bad, article, good = state[-1] if state else (False, False, False)
        if tag:
            link = link + 1 if tag == "a" else max(0, link - (tag == "/a"))
            if opens:
                evidence = weights.element(tag, text, article)
                bad = bad or evidence < BOILERPLATE
                article = article or tag in WHOLE
                good = good or article or evidence > -BOILERPLATE
                state.append((bad, article, good))
            found.append((tag, "", bad, article, 0, 0))
        else:
            found.append(("", text, bad, article, 0 if not link else 1 if good else -1, len(text.split())))
    whole = _articles_hold((n, article) for _, _, bad, article, _, n in found if n and not bad)
    out = []
    for tag, text, bad, article, linked, n in found:
        if tag:
            out.append((tag, "", bad, weights.tags.get(tag, UNSEEN)))
        else:
            bad = bad or whole and not article
            # Links count for content within an element that is told to be content; elsewhere they may be a menu.
            weight = (weights.aside if article else weights.beside) if bad and whole else weights.aside if bad else linked * weights.link if linked else weights.word
            out.append(("", text, bad, weight * n))
    return out


def extract(page: str | None, weights: Weights | None = None) -> str:
    """The main text of a page: blocks joined by newlines, white space within a block by one space."""
    if not page:
        return ""
    found = scored(page, weights or weights_of_labelled())
    begin, end = best_stretch([s for *_, s in found])
    blocks, block = [], []

    def close():
        line = " ".join("".join(block).split())
        if line:
            blocks.append(line)
        block.clear()

    for tag, text, bad, _ in found[begin:end]:
        if not tag:
            if not bad:
                block.append(text)
        elif tag.lstrip("/") in BLOCK:
            close()
        elif tag == "br":
            block.append(" ")
    close()
    return "\n".join(blocks)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of (page_id, url, html).

    A null or empty html, and one without content, gives an empty text. Whole pages are read,
    truncated ones as far as they go; time and memory are linear in a page's length. Repeated rows
    get a row each, an empty table gives none; page_id and url pass through, null or not; other columns
    aren't read.
    """

    weights = weights_of_labelled()  # a few hundred numbers, sent with the function

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only_cache("html_extract")
        for batch in batches:
            texts = [extract(h.as_py(), weights) for h in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
