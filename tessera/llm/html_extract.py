"""HTML extraction: the maximum-scoring subsequence of a page's words and tags.

Every word scores positive and every tag negative; both weights, and what the
elements around a word say, are log odds counted on labelled pages
(``LABELLED_PAGES``, or the caller's own). One linear scan finds the contiguous
region with the greatest sum. The region grows to the ``article`` or ``main``
elements that it touches, others come along if their words outweigh their tags,
and words of boilerplate inside (an advert between two paragraphs, reader
comments) stay out by their own weight.

Defined results: a null or empty page, and one without a word of content, has
an empty text and 0 characters. Pages are read one by one, whole, however long,
in time linear in their length; repeated rows repeat their result; clashing
input columns are replaced. Broken markup is read as far as it goes: a quote
that is never closed is an ordinary sign, a tag that is never closed ends the
page, an element that is never closed reaches to the end of what holds it.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
TAG_END = re.compile(r"""[>"']""")
ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
SPACES = re.compile(r"\s+")

#: Elements that are left out whole; the content of the first ones is not markup, so that without an end they reach to the end of the page.
OPAQUE = frozenset("script style textarea iframe title".split())
RAW = OPAQUE | frozenset("noscript template svg math select option object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr td th".split())
#: Elements that end a word even though no block ends.
SPACED = frozenset("br td th".split())
#: Elements that ``p`` and ``li`` end by themselves; they are never waited for.
UNTRACKED = INLINE | VOID | frozenset("p li dt dd h1 h2 h3 h4 h5 h6 tr thead tbody tfoot html body option".split())

#: Labelled pages: what stands between the two marks is content.
MARK = re.compile(r"<!--(/?)main-->")
_WORDS = "a short piece of running text that says what such a place on a page says "
_FEW = "home and more "  # boilerplate stands in short pieces
LABELLED_PAGES = tuple(
    f"<html><head><title>{_FEW}</title></head><body>{before}<{tag}><!--main--><h1>{_FEW}</h1><div><p>{_WORDS}</p></div><h2>{_FEW}</h2><!--/main-->{inside}<!--main--><p>{_WORDS}</p><ul><li>{_FEW}</li><li>{_FEW}</li></ul><blockquote><p>{_FEW * 2}</p></blockquote><!--/main--></{tag.split()[0]}>{after}</body></html>"
    for tag in ("article", "main", 'div class="article"', 'div class="content post entry story"', 'div id="main"', 'section class="body text"')
    for before, inside, after in (
        (
            f"<header><a href=x>{_FEW}</a></header><nav><ul><li><a href=x>{_FEW}</a></li><li><a href=x>home</a></li></ul></nav><div class=\"menu navigation navbar breadcrumb breadcrumbs\"><a>{_FEW}</a></div><div class=\"header masthead topbar\">{_FEW}</div>",
            f"<div class=\"ad ads advert advertisement adverts adsense sponsor sponsored promo promotion banner\">{_FEW}</div><form><p>{_FEW}</p></form><button>send</button>",
            f"<aside>{_FEW * 2}</aside><div class=\"sidebar widget related recommended\">{_FEW * 2}</div><div class=\"comments comment reply replies disqus respond discussion\"><p>{_FEW * 3}</p></div><footer>{_FEW}</footer><div class=\"footer copyright\">{_FEW}</div>",
        ),
        (
            f"<div class=\"notice notices cookie cookies consent gdpr alert popup modal overlay\"><p>{_FEW}</p></div><div role=\"navigation search\">{_FEW}</div><div role=\"banner alert dialog complementary contentinfo\">{_FEW}</div><menu><li>{_FEW}</li></menu><dialog>{_FEW}</dialog>",
            f"<div class=\"share social sharing subscribe newsletter signup login search toolbar pagination pager\"><a>{_FEW}</a></div><fieldset>{_FEW}</fieldset>",
            f"<div class=\"nav side rail tags meta byline disclaimer\">{_FEW}</div><section id=\"comments\"><p>{_FEW * 2}</p></section>",
        ),
        (
            f"<div class=\"toplinks links quicklinks sitemap skip crumbs navigation navi\"><a>{_FEW}</a></div><div class=\"hinweis aviso avis datenschutz privacy paywall gate\">{_FEW}</div><div class=\"werbung anzeige publicidad publicite pub dfp adsbygoogle\">{_FEW}</div>",
            f"<div class=\"taboola outbrain recirculation recirc trending popular readmore verwandt relacionados similaires\"><a>{_FEW}</a></div><div class=\"poll survey quiz rating ratings feedback contact formular\"><p>{_FEW}</p></div>",
            f"<div class=\"opinions opinion reviews testimonials kommentar kommentare comentarios commentaires meinungen leserbriefe reactions guestbook\"><p>{_FEW * 2}</p></div><div class=\"seitenleiste lateral teaser teasers authorbox\">{_FEW}</div><div class=\"impressum legal colophon pie\">{_FEW}</div>",
        ),
    )
)


@dataclass(frozen=True)
class Weights:
    word: float
    tag: float
    names: dict[str, float]


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kinds are open, close, text and mark. No stretch of the page is searched twice."""
    at, n = 0, len(page)
    last = {sign: page.rfind(sign) for sign in "\"'>"}
    endless: set[str] = set()  # elements of which no end comes any more
    while at < n:
        mark = page.find("<", at)
        if mark != at:
            yield "text", page[at : mark if mark >= 0 else n], ""
            if mark < 0:
                return
        following = page[mark + 1 : mark + 2]
        if following in ("!", "?"):
            comment = page.startswith("<!--", mark)
            end = page.find("-->" if comment else ">", mark + 1 if not comment else mark + 4)
            at = n if end < 0 else end + (3 if comment else 1)
            if comment and MARK.fullmatch(page[mark:at]):
                yield "mark", page[mark:at], ""
            continue
        closing = following == "/"
        name = NAME.match(page, mark + 1 + closing)
        if not name:
            yield "text", "<", ""
            at = mark + 1
            continue
        at = name.end()
        while True:  # to the end of the tag; a quote begins a value only behind an equals sign, and only if it is closed
            sign = TAG_END.search(page, at) if at <= last[">"] else None
            if not sign:
                return
            at = sign.end()
            if sign[0] == ">":
                break
            if at <= last[sign[0]] and page[name.end() : sign.start()][-64:].rstrip().endswith("="):
                at = page.find(sign[0], at) + 1
        attributes, tag = page[name.end() : at - 1], name[0].lower()
        if closing:
            yield "close", tag, ""
            continue
        yield "open", tag, attributes
        if tag in RAW and not attributes.endswith("/"):
            end = None if tag in endless else _end_of(tag).search(page, at)
            if end:
                at = end.end()
            elif tag in OPAQUE:
                at = n
            else:
                endless.add(tag)
            yield "close", tag, ""


@lru_cache(maxsize=1024)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)[^>]*+>?", re.IGNORECASE)


def _names(name: str, attributes: str) -> list[str]:
    """What an element calls itself: its own name and the parts of its class, id and role."""
    out = [name]
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id", "role"):
                out += ["." + x.lower() for x in NAME_PART.findall(value)]
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                out.append("?hidden")
    return out


def fit(pages=LABELLED_PAGES, smooth: float = 0.5) -> Weights:
    """Log odds of content against the rest, for words, tags and the names of the elements around a word."""
    words, tags, names = Counter(), Counter(), (Counter(), Counter())
    for page in pages:
        stack: list[list[str]] = []
        inside = 0
        for kind, value, attributes in _tokens(page):
            if kind == "mark":
                inside = int(value == "<!--main-->")
            elif kind == "text":
                k = len(value.split())
                words[inside] += k
                for x in {y for own in stack for y in own}:
                    names[inside][x] += k
            else:
                tags[inside] += 1
                if kind == "open" and value not in VOID:
                    stack.append(_names(value, attributes))
                elif kind == "close":
                    while stack and stack.pop()[0] != value:
                        pass
    base = math.log((words[1] + smooth) / (words[0] + smooth))
    odds = {x: math.log((names[1][x] + smooth) / (names[0][x] + smooth)) - base for x in {*names[0], *names[1]}}
    odds = {x: v for x, v in odds.items() if abs(v) > 1 and x.removeprefix(".") not in INLINE | {"p", "li", "ul", "h1", "body", "html", "head"}} | {"head": -9.0, "?hidden": -9.0}
    # Log odds that a word, or a tag, stands in content rather than in what is not; a page of words alone says nothing, so a word counts a little at least.
    share = lambda counts, other: counts / max(1, counts + other)
    word = math.log((share(words[1], tags[1]) + 1e-9) / (share(words[0], tags[0]) + 1e-9))
    tag = math.log((share(tags[1], words[1]) + 1e-9) / (share(tags[0], words[0]) + 1e-9))
    return Weights(word=max(0.05, word), tag=min(-0.05, tag), names=odds)


#: Letters that a name must begin or end with for a known word in it to count (``commentlist``, ``toplinks``).
LEAST_PART = 5


def _says(name: str, weights: Weights) -> float:
    """What a name, or the beginning or the end of a compound one, says against its element."""
    known = weights.names.get(name)
    if known is not None or not name.startswith("."):
        return known or 0.0
    parts = [x for k in range(LEAST_PART + 1, len(name)) for x in (name[:k], f".{name[k - 1 :]}") if len(x) > LEAST_PART]
    return min((weights.names.get(x, 0.0) for x in parts), default=0.0)


def best_region(scores: list[float]) -> tuple[int, int, float]:
    """The contiguous region with the greatest sum, as (first, behind the last, sum): of several the earliest and shortest; without a positive score, nothing."""
    first, last, best, run, start = 0, 0, 0.0, 0.0, 0
    for i, s in enumerate(scores):
        run += s
        if run <= 0:
            run, start = 0.0, i + 1
        elif run > best:
            first, last, best = start, i + 1, run
    return first, last, best


def extract(page: str | None, weights: Weights) -> str:
    """The main text of a page: blocks joined by an empty line."""
    scores: list[float] = []  # of all words and tags, in order
    parts: list[tuple[int, float, str]] = []  # of texts: place of the first word, a word's score, text
    breaks: list[int] = []  # parts that begin a block
    regions: list[tuple[str, int, int]] = []  # of article and main
    stack: list[tuple[str, float, int, bool]] = []  # element, least weight of what is open, place, whether its content counts as an article
    held: Counter = Counter()  # elements on the stack by name
    lows: dict[tuple[str, str], float] = {}  # what elements with these attributes say, each worked out once
    begins = True

    def push(name: str, low: float, article: bool = False) -> None:
        stack.append((name, min(stack[-1][1] if stack else 0.0, low), len(scores), article))
        held[name] += 1

    def pop() -> None:
        name, _, place, article = stack.pop()
        held[name] -= 1
        if article:
            regions.append((name, place, len(scores)))

    for kind, value, attributes in _tokens(page or ""):
        if kind == "text":
            text = html.unescape(value)
            count = len(text.split())
            if begins:
                breaks.append(len(parts))
                begins = False
            low = stack[-1][1] if stack else 0.0
            parts.append((len(scores), weights.word + low, text))
            scores += [weights.word if low >= 0 else -weights.word] * count
        elif kind in ("open", "close"):
            if value not in INLINE:
                begins = True
            elif value in SPACED:
                parts.append((len(scores), weights.word, " "))
            scores.append(weights.tag if value not in INLINE else weights.tag / 4)
            if kind == "close":
                if value not in UNTRACKED or stack and stack[-1][0] == value:
                    while held[value]:  # also what was left open inside
                        ends = stack[-1][0] == value
                        pop()
                        if ends:
                            break
                continue
            if (key := (value, attributes)) not in lows:
                lows[key] = _low(value, attributes, weights)
            low = lows[key]
            if value in VOID or value in INLINE:
                continue
            while stack and stack[-1][0] in UNTRACKED:
                pop()  # the next block ends one that was not closed
            if value in RAW:
                push(value, -9.0)
            elif value not in UNTRACKED:
                push(value, low, value in ("article", "main") and low >= 0 and (stack[-1][1] if stack else 0.0) >= 0)
            elif low < 0 and value not in ("html", "body"):
                push(value, low)  # tracked for its class
    while stack:
        pop()
    # Where a page says what its articles are, what lies outside counts as boilerplate; an article says more than a main.
    words = list(accumulate((s > 0 for s in scores), initial=0))
    spans: list[tuple[int, int]] = []
    for name in ("article", "main"):
        for a, b in sorted((a, b) for x, a, b in regions if x == name and words[b] > words[a]):
            if spans and a < spans[-1][1]:  # one inside the other
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))
        if spans:
            inside = bytearray(len(scores))
            for a, b in spans:
                inside[a:b] = b"\x01" * (b - a)
            scores = [s if i else min(s, -weights.word) for s, i in zip(scores, inside, strict=True)]
            break
    first, last, best = best_region(scores)
    if best <= 0:
        return ""
    # Of several articles, those that the region touches and those whose own words outweigh their tags.
    chosen = [(a, b) for a, b in spans if a < last and b > first or sum(scores[a:b]) > 0] or [(first, last)]
    blocks, now, at, k = [], [], set(breaks), 0
    for i, (place, weight, text) in enumerate(parts):
        if i in at and now:
            blocks.append("".join(now))
            now = []
        while k < len(chosen) - 1 and place >= chosen[k][1]:
            k += 1
        if weight > 0 and chosen[k][0] <= place < chosen[k][1]:
            now.append(text)
    blocks.append("".join(now))
    return "\n\n".join(b for b in (SPACES.sub(" ", x).strip() for x in blocks) if b)


def _low(value: str, attributes: str, weights: Weights) -> float:
    """The strongest word against an element, or 0; what speaks for it never outweighs that."""
    return min([0.0, *(_says(x, weights) for x in _names(value, attributes))])


def extract_pages(pages: DataFrame, page: str = "html", weights: Weights | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns but the page unless named), the main text, and its length in code points."""
    weights = weights or fit()
    keep = [c for c in (pages.columns if keep is None else keep) if c.lower() not in ("text", "n_chars") and (keep is not None or c != page)]
    source = pages.select(*[f"`{c}`" for c in dict.fromkeys([*keep, page])])
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [extract(x.as_py(), weights) for x in part.column(part.schema.get_field_index(page))]
                arrays = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return source.mapInArrow(extracted, schema)
