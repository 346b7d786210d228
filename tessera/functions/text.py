"""Text of source payloads: tag lists, ratings, links, entities, dates."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

#: The entities that escaped markup needs; anything else goes to ``html_unescape``.
BASIC_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&"))
#: The ``tags`` parameter of a link's address.
TAGS_PARAMETER = r"(?i)href\s*=\s*[\"'][^\"'>]*?[?&;]tags=([^\"'&>]+)"


def tag_list(text: Column) -> Column:
    """Names of a blank-separated list, without empty ones."""
    return F.filter(F.split(text, " "), lambda x: x != "")


def rating_letter(rating: Column) -> Column:
    return F.substring(rating, 1, 1)


def unescape_basic(text: Column) -> Column:
    """Decodes the basic entities inside the JVM; ``&amp;`` last, so that nothing is decoded twice."""
    for entity, char in BASIC_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


@pandas_udf(T.StringType())
def html_unescape(text: pd.Series) -> pd.Series:
    """Decodes every character reference, by name or number."""
    return text.map(html.unescape, na_action="ignore")


def url_unescape(text: Column) -> Column:
    """Percent decoding that leaves a plus sign alone."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def url_escape(text: Column) -> Column:
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def alias_pairs(page: Column) -> Column:
    """Pairs (antecedent, consequent) of an alias listing page, still percent- and entity-coded: the first two ``tags`` links of each table row that has two."""
    rows = F.slice(F.split(page, r"(?i)<tr\b"), 2, 1 << 30)
    links = F.transform(rows, lambda row: F.regexp_extract_all(F.regexp_extract(row, r"(?is)^(.*?)(?:</tr|$)", 1), F.lit(TAGS_PARAMETER), F.lit(1)))
    return F.transform(F.filter(links, lambda x: F.size(x) >= 2), lambda x: F.struct(x[0].alias("antecedent"), x[1].alias("consequent")))


def asctime(text: Column, fallback: Column | None = None) -> Column:
    """``Fri Jan 01 00:00:00 +0000 2021``; the weekday says nothing and is dropped. What cannot be read is the fallback."""
    parsed = F.try_to_timestamp(F.substring(text, 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy"))
    return F.coalesce(parsed, fallback) if fallback is not None else parsed


def as_asctime(ts: Column) -> Column:
    return F.date_format(ts, "EEE MMM dd HH:mm:ss Z yyyy")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSXXX")


def tags_from_json(text: Column) -> Column:
    """A stored tag list; null (never captured) stays null and differs from an empty list."""
    return F.from_json(text, "array<string>")


def fixed(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", value)
