"""License scans: an Aho-Corasick automaton finds notice phrases and identifier
tags in the words of a text; a shunting-yard parser evaluates the licence
expression behind a tag.

A text's words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are
lower-cased. All phrases are searched in one pass over the words joined by one
space, with a space at either end, so a match begins and ends with a word.

Defined results: a null text is empty; a text without a match has no place,
empty labels and score 0. Rows are judged one by one, so repeated rows and
ties need no rule; an input column that clashes with a result is replaced. An
expression that cannot be parsed gives the identifiers read up to the fault; a
word that begins like no known family of licences is a fault.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})

#: The phrases whose places are counted as base places.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices, as words; each gives a label of its own.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "gnu general public license version 3": "gpl-3", "gnu general public license version 2": "gpl-2", "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd", "bsd 3 clause": "bsd-3-clause", "bsd 2 clause": "bsd-2-clause",
    "eclipse public license": "epl", "the unlicense": "unlicense", "cc by nc nd": "cc-by-nc-nd", "cc by nc sa": "cc-by-nc-sa", "cc by sa": "cc-by-sa", "cc by": "cc-by", "cc0": "cc0",
    "creative commons attribution": "cc-by", "isc license": "isc", "boost software license": "bsl-1", "all rights reserved": "all-rights-reserved",
    "licensed under the mit": "mit", "licensed under the apache": "apache-2", "public domain dedication": "public-domain",
}
#: How freely a text under the label may be used, from 0 to 1; labels outside the table count as ``UNKNOWN_SCORE``.
FREEDOM = {
    "mit": 1.0, "apache-2": 1.0, "apache-2.0": 1.0, "bsd": 1.0, "bsd-2-clause": 1.0, "bsd-3-clause": 1.0, "isc": 1.0, "unlicense": 1.0, "cc0": 1.0, "cc0-1.0": 1.0, "bsl-1": 1.0, "bsl-1.0": 1.0, "public-domain": 1.0, "0bsd": 1.0, "zlib": 1.0,
    "cc-by": 0.9, "cc-by-4.0": 0.9, "mpl": 0.7, "mpl-2.0": 0.7, "epl": 0.7, "epl-2.0": 0.7, "cc-by-sa": 0.6, "cc-by-sa-4.0": 0.6, "lgpl": 0.6, "lgpl-2.1": 0.6, "lgpl-3.0": 0.6,
    "gpl": 0.4, "gpl-2": 0.4, "gpl-2.0": 0.4, "gpl-3": 0.4, "gpl-3.0": 0.4, "agpl": 0.3, "agpl-3.0": 0.3, "cc-by-nc": 0.2, "cc-by-nc-4.0": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.1, "all-rights-reserved": 0.0, "proprietary": 0.0,
}
UNKNOWN_SCORE = 0.5
#: Labels that notices give, for the identifiers of the same licences.
SAME = {"apache-2.0": "apache-2", "gpl-2.0": "gpl-2", "gpl-3.0": "gpl-3", "bsl-1.0": "bsl-1", "cc0-1.0": "cc0"}
#: What an identifier begins with, in front of a hyphen, a version or nothing; other words behind a tag (``see file``) are no licence.
FAMILIES = "0bsd aal adobe afl agpl apache apsl artistic beerware bsd bsl bzip2 cc cc0 cddl cecill cpl curl ecl efl epl etalab eupl fsfap ftl gfdl gpl hpnd icu ijg imagemagick intel ipl isc json lgpl libpng licenseref lppl mit mpl ms mulanpsl ncsa ngpl odbl odc ofl openssl osl php postgresql proprietary psf python qpl rpl ruby sissl sleepycat spl ssh unicode unlicense upl vim w3c watcom wtfpl x11 xfree86 xnet zend zlib zpl".split()
IDENTIFIER = re.compile(rf"(?:{'|'.join(FAMILIES)})(?:[-.0-9+].*)?")
#: What an exception after WITH adds to the licence's freedom.
EXCEPTION_BONUS = 0.2
TAG = "spdx license identifier"
#: The expression of a tag: up to the line's end. Every tag has its colon, so the scan asks for it in the text itself.
TAG_TEXT = re.compile(r"spdx-license-identifier:[ \t]*([^\r\n]*)", re.IGNORECASE)
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+-]+")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}


def parse_expression(text: str) -> list[str]:
    """Reverse Polish form of a licence expression, by the shunting-yard method; reading ends at the first token that does not fit."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether an identifier or "(" has to come next
    for m in TOKEN.finditer(text):
        t = m[0]
        low = t.lower().rstrip(".") if t not in "()" else t
        if low == "(":
            if not operand:
                break
            stack.append("(")
        elif low == ")":
            if operand or "(" not in stack:
                break
            while (top := stack.pop()) != "(":
                out.append(top)
        elif low in PRECEDENCE:
            if operand:
                break
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        else:
            exception = bool(stack) and stack[-1] == "with"
            if not operand or not ("exception" in low if exception else IDENTIFIER.fullmatch(low)):
                break
            out.append("=" + low)
            operand = False
    pending = [x for x in stack[::-1] if x != "("]
    if operand and pending:
        pending.pop(0)  # an operator whose right side is missing
    return out + pending


def evaluate(rpn: list[str], freedom: dict[str, float] = FREEDOM) -> tuple[float | None, set[str]]:
    """Freedom and identifiers of a parsed expression: AND takes the lesser, OR the greater, WITH adds the exception's bonus."""
    stack: list[tuple[float, set[str]]] = []
    for t in rpn:
        if t[0] == "=":
            name = re.sub(r"(-only|-or-later|\+)$", "", t[1:])
            stack.append((freedom.get(name, UNKNOWN_SCORE), {name}))
            continue
        (b, right), (a, left) = stack.pop(), stack.pop()
        if t == "with":
            stack.append((min(1.0, a + EXCEPTION_BONUS), {f"{x}-with-{y}" for x in left for y in right}))
        else:
            stack.append(((min if t == "and" else max)(a, b), left | right))
    return stack[-1] if stack else (None, set())


class Scanner:
    """The automaton over base phrases, notices and the identifier tag; a few kilobytes, built once in each task."""

    def __init__(self, base=BASE_PHRASES, notices=NOTICE_PHRASES) -> None:
        self.automaton = ahocorasick.Automaton()
        phrases: dict[str, list[tuple[str, str | None]]] = {}
        for kind, table in (("base", base), ("notice", notices), ("tag", {TAG: None})):
            for phrase, label in table.items():
                phrases.setdefault(phrase, []).append((kind, label))
        for phrase, meanings in phrases.items():
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 2, meanings))
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple:
        words = WORD.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
        joined = f" {' '.join(words)} "
        places, base, labels, scores, spans = [], set(), set(), [], []
        tagged = False
        for end, (size, meanings) in self.automaton.iter(joined):
            start = end - size + 1
            for kind, label in meanings:
                tagged |= kind == "tag"
                if kind == "base":
                    places.append(start)
                    base.add(label)
                if label:
                    labels.add(label)
                    scores.append(FREEDOM.get(label, UNKNOWN_SCORE))
                    spans.append((start, label))
        if tagged:
            for m in TAG_TEXT.finditer(text):
                score, names = evaluate(parse_expression(m[1]))
                labels |= {SAME.get(x, x) for x in names}
                scores += [score] if score is not None else []
        # A place's word number: the spaces in front of it.
        starts = np.sort(np.array(sorted({*places, *[s for s, _ in spans]}), np.int64))
        blanks = {}
        at = count = 0
        for s in starts.tolist():
            count += joined.count(" ", at, s)
            at = s
            blanks[s] = count
        where = [blanks[s] for s in places]
        found = [{"word": blanks[s], "label": x} for s, x in sorted(spans)]
        return len(words), len(places), min(where, default=None), max(where, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), min(scores, default=0.0), found


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("places", T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("label", T.StringType())]))),
    ]
)
_ARROW = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))]


def scan_licenses(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns unless named) with word count, base places, labels, every place, and a score.

    ``score`` is the least freedom among what was found (0 without a licence): the text may be used as freely as its strictest notice says.
    """
    names = {f.name for f in RESULT}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    source = docs.select(*[f"`{c}`" for c in dict.fromkeys([*keep, text])])
    schema = T.StructType([*[source.schema[c] for c in keep], *RESULT])

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            rows = [scanner.scan(x.as_py() or "") for x in column]
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(_ARROW)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            arrays += [pa.array(c, t) for c, t in zip(cols, _ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *[f.name for f in RESULT]])

    return source.mapInArrow(scanned, schema)
