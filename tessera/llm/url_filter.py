"""URL filters: host word segmentation by a unigram Viterbi search, then a
multinomial naive Bayes score of the segmented host and path tokens.

The naive Bayes model is fitted on a labelled list of URLs, by default
``labelled_urls.txt`` beside this module (made up; a caller with labels of their
own passes them, at most ``max_labelled`` a class). The unigram counts are those
of the list, of some common words, and of the parts of all hosts and paths that
are judged: a part that ``MIN_HOSTS`` hosts share is a word, and counts as often
as it occurs; ``MAX_WORDS`` words at most, the most frequent ones. The model is
small by that bound and travels inside the task. Judging is one Arrow pass.

Defined results: a null URL, or one without ``://``, has an empty host and an
empty path, matches no rule and is allowed (there is nothing to hold against
it). A host and path without a known word have no score and are allowed. Rows
are judged one by one: repeated rows repeat their result, and input columns
whose names clash with results are replaced. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

LABELLED_URLS = Path(__file__).with_name("labelled_urls.txt")
#: Hosts that share a part for it to count as a word, and words of the unigram model.
MIN_HOSTS, MAX_WORDS = 3, 100_000
#: Further frequent words, so that names made of them are cut where a reader would.
COMMON_WORDS = """
the and for with from this that your our all new home page index online web site shop store blog news info net world
best top big free live play game games video videos photo music book books city house garden health food travel school
science history art sport sports club forum wiki data cloud soft ware tech time day night water green blue red black white
""".split()

TOKEN = re.compile(r"[^\W\d_]+|\d+")
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
NEUTRAL = frozenset("www m blog com net org html htm php index page test example en de fr es http https".split())


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]


def rule_of(host: str, path: str, rules=RULES) -> tuple[str | None, str | None]:
    """The longest rule that fits and its verdict."""
    best: tuple[int, str, str] | None = None
    for domain, prefix, verdict in rules:
        if (host == domain or host.endswith("." + domain)) and path.startswith(prefix):
            best = max(best or (-1, "", ""), (len(domain) + len(prefix), domain + prefix, verdict), key=lambda x: x[0])
    return (best[1], best[2]) if best else (None, None)


@dataclass
class Segmenter:
    """Cuts concatenated names into the words that make them likeliest under a unigram model.

    A piece that is no known word costs ``unknown`` plus ``per_char`` a character, so it stays whole unless known words explain nearly all of it.
    """

    counts: dict[str, int]
    unknown: float = 11.0
    per_char: float = 1.6
    log: dict[str, float] = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self) -> None:
        total = sum(self.counts.values()) + len(self.counts)
        self.log = {w: -math.log((c + 1) / total) for w, c in self.counts.items()}
        self.longest = max(map(len, self.log), default=1)

    def split(self, name: str) -> list[str]:
        """Viterbi over cut places; time is linear in the name, as words have a longest length and an unknown piece is carried on."""
        n = len(name)
        cost, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        open_cost, open_at = math.inf, 0  # the cheapest unknown piece that goes on here
        for j in range(1, n + 1):
            start = cost[j - 1] + self.unknown
            if start < open_cost:
                open_cost, open_at = start, j - 1
            open_cost += self.per_char
            cost[j], back[j] = open_cost, open_at
            for i in range(max(0, j - self.longest), j):
                if (c := self.log.get(name[i:j])) is not None and cost[i] + c < cost[j]:
                    cost[j], back[j] = cost[i] + c, i
        out = []
        while n:
            out.append(name[back[n] : n])
            n = back[n]
        return out[::-1]


@dataclass
class UrlModel:
    segmenter: Segmenter
    weights: dict[str, float]
    prior: float
    threshold: float = 0.0

    def tokens(self, host: str, path: str) -> list[str]:
        out = []
        labels = host.split(".")
        for name in TOKEN.findall(" ".join(labels[:-1] if len(labels) > 1 else labels)) + TOKEN.findall(path):
            out += self.segmenter.split(name.lower()) if name.isalpha() else []
        return [w for w in out if w not in NEUTRAL]

    def score(self, host: str, path: str) -> float | None:
        """Log odds of block against allow; words without a weight say nothing, and if there are no others there is no score."""
        known = [self.weights[w] for w in self.tokens(host, path) if w in self.weights]
        return self.prior + sum(known) if known else None

    def verdict(self, score: float | None) -> str:
        return "block" if score is not None and score > self.threshold else "allow"


def labelled(path: Path = LABELLED_URLS) -> tuple[list[str], list[str]]:
    """The blocked and the allowed URLs of a list."""
    lines = [x.split() for x in path.read_text(encoding="utf-8").splitlines() if x.strip() and not x.startswith("#")]
    return [u for y, u in lines if y == "block"], [u for y, u in lines if y == "allow"]


def corpus_words(pages: DataFrame, url: str = "url", min_hosts: int = MIN_HOSTS, max_words: int = MAX_WORDS) -> dict[str, int]:
    """How often the words of all hosts and paths occur: their parts between signs that at least ``min_hosts`` hosts share."""
    rest = F.regexp_extract(F.col(url), r"^.*?://([^?#]*)", 1)
    host = F.lower(F.substring_index(rest, "/", 1))
    each = pages.select(host.alias("host"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(rest), F.lit(r"([a-z]{2,})"), F.lit(1)))).alias("word"))
    # Once for each host and word, then for each word: a host with a third of all pages is one row by then.
    pairs = each.groupBy("word", "host").agg(F.count("*").alias("n"))
    words = pairs.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("hosts")).where(F.col("hosts") >= min_hosts)
    return {r["word"]: r["n"] for r in words.orderBy(F.desc("n"), "word").limit(max_words).collect()}


def fit(blocked: list[str] | None = None, allowed: list[str] | None = None, seen: dict[str, int] | None = None, words=tuple(COMMON_WORDS), max_labelled: int = 100_000, smooth: float = 0.5) -> UrlModel:
    """Fits both models on at most ``max_labelled`` URLs of each class, in the order given; ``seen`` are counts of further words.

    Words are the parts that hyphens and slashes separate in the list; the naive Bayes counts are over segmented tokens, once a URL.
    """
    if blocked is None or allowed is None:
        blocked, allowed = labelled()
    urls = [(u, y) for own, y in ((blocked, 1), (allowed, 0)) for u in own[:max_labelled]]
    counts = Counter(words)
    for u, _ in urls:
        host, _, path = u.partition("/")
        counts.update(p.lower() for x in (host.split(".")[0], path) for p in TOKEN.findall(x) if len(p) > 1)
    listed = sum(counts.values())
    total = sum((seen or {}).values())
    for w, n in (seen or {}).items():  # all pages together weigh as much as the list, so that frequent names of theirs are not cheaper than words
        counts[w] += max(1, round(n * listed / total))
    segmenter = Segmenter({w: c for w, c in counts.items() if w.isalpha() and len(w) > 1})
    model = UrlModel(segmenter, {}, 0.0)
    held = (Counter(), Counter())
    for u, y in urls:
        host, _, path = u.partition("/")
        held[y].update(set(model.tokens(host, path)))
    vocab = set(held[0]) | set(held[1])
    size = [sum(c.values()) + smooth * len(vocab) for c in held]
    model.weights = {w: math.log((held[1][w] + smooth) / size[1]) - math.log((held[0][w] + smooth) / size[0]) for w in vocab}
    model.prior = math.log(max(1, len(blocked)) / max(1, len(allowed)))
    return model


RESULT = T.StructType(
    [T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("host_words", T.StringType())]
)


def judge_urls(pages: DataFrame, url: str = "url", rules=RULES, model: UrlModel | None = None) -> DataFrame:
    """``pages`` with host, path, rule, verdict, the method's score (log odds; null: no known word) and the host's words."""
    model = model or fit(seen=corpus_words(pages, url))
    keep = [c for c in pages.columns if c.lower() not in {f.name for f in RESULT}]
    source = pages.select(*[f"`{c}`" for c in dict.fromkeys([*keep, url])])
    schema = T.StructType([*[f for f in source.schema if f.name in keep], *RESULT])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts: dict[tuple[str, str], tuple] = {}
        for batch in batches:
            rows = []
            for u in batch.column(batch.schema.get_field_index(url)).to_pylist():
                host, path = split_url(u)
                rule, verdict = rule_of(host, path, rules)
                key = (host, re.sub(r"\d+", "0", path))  # digits have no weight
                if key not in hosts:
                    if len(hosts) > 50_000:
                        hosts.clear()
                    hosts[key] = (model.score(host, path), " ".join(w for x in host.split(".") for y in TOKEN.findall(x) for w in model.segmenter.split(y)))
                score, words = hosts[key]
                rows.append((host, path, rule, verdict or model.verdict(score), score, words))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            arrays += [pa.array(c, pa.float64() if f.dataType == T.DoubleType() else pa.string()) for c, f in zip(cols, RESULT, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *[f.name for f in RESULT]])

    return source.mapInArrow(judged, schema)
