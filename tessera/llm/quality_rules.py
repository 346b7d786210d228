"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a Catalyst expression over the text column, so the operator
is a single projection behind the scan: no shuffle, no user function, one row
in, one row out. Words are ``[^\\x20\\x09-\\x0D]+``.

Defined results: a null text is a text without words; an empty text has zero
for every measure; both fail ``n_words >= 10``. Rows are judged one by one, so
ties, repeated rows and null ids need no rule. Columns of the input that clash
with a result column are replaced by the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
SHOUT_MARKS = "!?"

#: Frequent function words of the four languages the corpus is in.
STOP_WORDS = (
    "the be to of and that have with for as was on are by this from at is in it a an or "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es "
    "de la le les et des en un une du que est pour qui dans par sur au plus pas avec "
    "el los las y del se por con no su para al lo como más o pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """Rejects a text whose ``measure`` is outside ``[low, high]``; a missing bound holds always.

    ``at_least_words``: the rule speaks only about texts of so many words, as a ratio says little about a short one.
    """

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    at_least_words: int = 0

    def broken(self, measures: dict[str, Column]) -> Column:
        value, out = measures[self.measure], F.lit(False)
        if self.low is not None:
            out = out | (value < F.lit(self.low))
        if self.high is not None:
            out = out | (value > F.lit(self.high))
        if self.at_least_words:
            out = out & (measures["n_words"] >= F.lit(self.at_least_words))
        return F.coalesce(out, F.lit(False))


RULES = (
    Rule("few_words", "n_words", low=10),
    Rule("repeated_words", "repeat_percent", high=20),
    Rule("word_length", "mean_word_chars", low=1.5, high=20, at_least_words=10),
    Rule("symbols", "symbols_per_word", high=0.3, at_least_words=10),
    Rule("shouting", "shouts_per_word", high=0.3, at_least_words=10),
    Rule("repeated_lines", "dup_line_ratio", high=0.5, at_least_words=10),
    Rule("no_stop_words", "stop_word_ratio", low=0.01, at_least_words=100),
)
#: The rules that decide ``base_failed``.
BASE_RULES = ("few_words", "repeated_words")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: inside a higher-order function it would be computed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words of a text: once its ends are trimmed, splitting leaves no empty word."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE, -1))


def count_of(text: Column, characters: str) -> Column:
    """How many of ``characters`` a text has."""
    return F.regexp_count(text, F.lit(f"[{characters}]")).cast("long")


def repeated_window_words(words: Column, size: int = 5) -> Column:
    """How many of ``words`` stand in a window of ``size`` words that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        """Of the sorted (hash, place) pairs those whose hash has a neighbour; then the length of the union of their windows."""
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            n = F.size(s)
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
            found = F.filter(F.sequence(F.lit(0), n - 1), lambda j: same(j, j + 1) | ((j > 0) & same(j, j - 1)))
            return F.sort_array(F.transform(found, lambda j: F.get(s, j)["i"]))

        def union(p: Column) -> Column:
            last = F.lit(size)
            return F.aggregate(
                F.sequence(F.lit(0), F.size(p) - 1),
                F.lit(0).cast("long"),
                lambda total, j: total + F.coalesce(F.least(last, F.get(p, j + 1) - F.get(p, j)), last),
            )

        return let(pairs, lambda s: let(places(s), union))

    def windows(w: Column) -> Column:
        """Words are hashed once, windows are hashes of word hashes; those that reach beyond the end are cut off."""
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return let(hashes, lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, size)])), F.lit(1), F.size(h) - (size - 1)))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long"))

    return let(words, lambda w: F.when(F.size(w) < size + 1, F.lit(0).cast("long")).otherwise(let(windows(w), count)))


#: A stop word as it stands in running text.
STOP_FORMS = sorted({form for w in STOP_WORDS for x in (w, w.capitalize()) for form in (x, f"{x},", f"{x}.")})


def measures(text: Column) -> dict[str, Column]:
    """All measures of a text that is not null; its words are split once."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("repeated")))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n"),
            F.length(F.array_join(w, "")).cast("long").alias("chars"),
            repeated_window_words(w).alias("repeated"),
            F.size(F.filter(w, lambda x: x.isin(STOP_FORMS))).cast("long").alias("stops"),
        )

    return {"n_symbols": count_of(text, SYMBOLS), "n_shouts": count_of(text, SHOUT_MARKS), "lines": of_lines, "words": let(words_of(text), of_words)}


def verdict(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """All measures of a text, ``base_failed``, ``failed_rules`` and ``kept`` as one struct.

    It is one expression in which everything is computed once, so a filter on a part of it may be moved ahead of the
    projection without computing the measures again for each column that it mentions.
    """
    known = measures(F.coalesce(text, F.lit("")))

    def judged(m: Column) -> Column:
        w, lines = m["words"], m["lines"]
        words = F.greatest(w["n"], F.lit(1))
        ratios = {
            "n_words": w["n"],
            "repeat_percent": F.lit(100) * w["repeated"] / words,
            "mean_word_chars": w["chars"] / words,
            "symbols_per_word": m["n_symbols"] / words,
            "shouts_per_word": m["n_shouts"] / words,
            "dup_line_ratio": lines["repeated"] / F.greatest(lines["n"], F.lit(1)),
            "stop_word_ratio": w["stops"] / words,
        }
        # 100 * n_repeat_words > 20 * n_words is asked in whole numbers, so that no quotient is rounded.
        broken = {r.name: (100 * w["repeated"] > int(r.high) * w["n"]) if r.measure == "repeat_percent" else r.broken(ratios) for r in rules}
        base, any_broken = F.lit(False), F.lit(False)
        for name, b in broken.items():
            any_broken = any_broken | b
            base = base | b if name in BASE_RULES else base
        failed = F.filter(F.array(*[F.when(b, F.lit(name)) for name, b in broken.items()]), lambda x: x.isNotNull())
        parts = {"n_words": w["n"], "word_chars": w["chars"], "n_symbols": m["n_symbols"], "n_shouts": m["n_shouts"], "n_lines": lines["n"], "n_dup_lines": lines["repeated"], "n_repeat_words": w["repeated"], "n_stop_words": w["stops"], "failed_rules": failed, "base_failed": base, "kept": ~any_broken}
        return F.struct(*[c.alias(name) for name, c in parts.items()])

    return let(F.struct(*[c.alias(name) for name, c in known.items()]), judged)


RESULTS = ("n_words", "word_chars", "n_symbols", "n_shouts", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "failed_rules", "base_failed", "kept")


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``failed_rules`` and ``kept``.

    ``kept`` is false for a text that breaks any rule of the table.
    """
    out = docs.withColumn("__judged", verdict(F.col(text), rules))
    return out.withColumns({name: F.col(f"__judged.{name}") for name in RESULTS}).drop("__judged")


def passing(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` whose text breaks no rule, with their own columns."""
    return docs.where(verdict(F.col(text), rules)["kept"])
