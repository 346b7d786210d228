"""Quality classifier: an interpolated modified Kneser-Ney model of order 4 over
the characters of trusted texts, and per-document perplexity held against
language-specific quantiles.

The model's units are characters, all of them: a gram is ``ORDER`` code points, a
text's border among them. Whole texts of all trusted documents are counted (all
but a fifth, which set the thresholds). Counts are summed by Spark, sharded by
their history; continuation counts, discounts and interpolation weights are
aggregations of those shards.

Of grams that hold a language's ``DIGITS`` most frequent characters only there are
at most ``SYMBOLS ** ORDER``, whatever the corpus, so their finished log
probabilities (16 bits each, 10.6 MB a language) are small enough by construction
to be sent to the tasks, for ``LANGUAGES_AT_ONCE`` languages at a time, and no
such gram of a document is shuffled. Every other gram of a document is a row, to
which its logarithm is joined: such grams are among the counted ones from the
start, those that no counted text has with a count of 0, so one chain of joins
from order to order gives them all. Every language with
``LEAST_TRUSTED`` trusted texts has a model and a threshold of its own.

Defined results: null and empty texts have no perplexity and are not kept. A
null language is ``other``. Of a language with fewer trusted texts nothing is
known: every text with a character is kept, at a null perplexity and threshold.
Labels that contradict each other for an id: trusted if at least half say so.
Repeated rows repeat their result. Clashing columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.common import cut, steps, utf8

ORDER = 4
SYMBOLS = 48
BORDER, ESCAPE = 0, 1
#: Digits of a spelled character, and how many characters three of them tell apart; others take four behind a mark.
DIGITS = SYMBOLS - 2
SHORT = DIGITS**3
#: Code points to the base of which wide grams are numbers, the border's, how many there are (each as likely where nothing is known), and parts of a logarithm's unit, in which logarithms are summed as whole numbers.
WIDE, EDGE, SIZE = 1 << 21, 0x110000, 0x110000 + 1
LOG_UNIT = 1 << 20
LANGUAGES_AT_ONCE = 8
LEAST_TRUSTED = 5
QUANTILE = 0.95
#: Of the trusted documents one in so many is not counted but held against the model, as a threshold from counted texts would be too strict for others.
HELD_OUT_OF = 5
#: Held-out texts of a language that have a quantile of their own; of fewer the threshold is the bound under which the next text is with that probability, if log perplexity is normal.
ENOUGH = 20
#: Ids of trusted documents that are sent to the tasks; beyond, documents and ids are joined by a shuffle.
BROADCAST_IDS = 1_000_000
WINDOW_CHARS = 1 << 20
#: Rare grams that a task sums up before they are rows.
TALLIED = 1 << 18


def _code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts and where each text's begin; the last entry is the end."""
    data, offsets = utf8(texts)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return points, leads[offsets]


def _rows_by(values: pa.Array) -> dict[str, np.ndarray]:
    found: dict[str, list[int]] = {}
    for i, v in enumerate(values.to_pylist()):
        v = tuple(v.values()) if isinstance(v, dict) else v
        found.setdefault(v, []).append(i)
    return {k: np.array(v) for k, v in found.items()}


def _characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code point, count) of (lang, text)."""
    sums: dict[str, np.ndarray] = {}
    for whole in batches:
        for batch in steps(whole):
            for lang, rows in _rows_by(batch.column(0)).items():
                points, _ = _code_points(batch.column(1).take(pa.array(rows)))
                own = np.bincount(points)
                known = sums.get(lang, np.zeros(0, np.int64))
                wide = np.zeros(max(len(own), len(known)), np.int64)
                wide[: len(own)] += own
                wide[: len(known)] += known
                sums[lang] = wide
    for lang, own in sums.items():
        point = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(point), pa.string()), pa.array(point.astype(np.int32)), pa.array(own[point].astype(np.int64))], names=["lang", "point", "n"])


def _symbol_tables(alphabet: dict[str, list[int]]) -> dict[str, np.ndarray]:
    out = {}
    for lang, points in alphabet.items():
        table = np.full(max([*points, 0x7F]) + 2, ESCAPE, np.uint8)
        table[points] = np.arange(len(points)) + 2
        out[lang] = table
    return out


def _symbols(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Symbols of all texts, each behind ``ORDER - 1`` borders and closed by one; where each text begins, the last entry is the end; and the
    numbers of the grams that spell its escaped characters, as some (texts, numbers)."""
    points, at = _code_points(texts)
    codes = table[np.minimum(points, len(table) - 1)]
    starts = at + ORDER * np.arange(len(at))
    out = np.zeros(starts[-1], np.uint8)
    out[np.arange(len(codes)) + np.repeat(starts[:-1] - at[:-1] + ORDER - 1, np.diff(at))] = codes
    rare = np.flatnonzero(codes == ESCAPE)
    owner = np.searchsorted(at, rare, "right") - 1
    return out, starts, [(owner[own], number) for own, number in _spelled(points[rare].astype(np.int64))]


def _spelled(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Which characters, and a gram of each: an escape and a border, which follow on one another in no text, lead to the first digits."""
    gram = lambda *x: ((x[0] * SYMBOLS + x[1]) * SYMBOLS + x[2]) * SYMBOLS + x[3]
    d = [points // DIGITS**k % DIGITS + 2 for k in range(4)]  # the last digit first
    all_, long = np.arange(len(points)), points >= SHORT
    yield all_[~long], gram(ESCAPE, BORDER, BORDER, d[2])[~long]
    yield all_[~long], gram(ESCAPE, BORDER, d[2], d[1])[~long]
    yield all_[~long], gram(BORDER, d[2], d[1], d[0])[~long]
    if long.any():
        yield all_[long], np.full(int(long.sum()), gram(ESCAPE, BORDER, BORDER, BORDER))
        yield all_[long], gram(ESCAPE, ESCAPE, BORDER, d[3])[long]
        yield all_[long], gram(ESCAPE, BORDER, d[3], d[2])[long]
        yield all_[long], gram(BORDER, d[3], d[2], d[1])[long]
        yield all_[long], gram(BORDER, d[2], d[1], d[0])[long]


def _windows(symbols: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers of the ``ORDER``-grams that end at each place from ``ORDER - 1`` on, some at a time."""
    for at in range(0, len(symbols) - ORDER + 1, WINDOW_CHARS):
        to = min(len(symbols), at + WINDOW_CHARS + ORDER - 1)
        number = np.zeros(to - at - ORDER + 1, np.int64)
        for k in range(ORDER):
            number = number * SYMBOLS + symbols[at + k : to - ORDER + 1 + k]
        yield at + ORDER - 1, number


def _counter(tables):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, number, count) of trusted (lang, text); windows across two texts hold no text's character at the end and are left out."""
        own = tables.value
        sums: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in steps(whole):
                for lang, rows in _rows_by(batch.column(0)).items():
                    symbols, starts, spelled = _symbols(batch.column(1).take(pa.array(rows)), own[lang])
                    inside = np.ones(len(symbols), bool)
                    for k in range(ORDER - 1):
                        inside[starts[:-1] + k] = False
                    total = sums.setdefault(lang, np.zeros(SYMBOLS**ORDER, np.int32))
                    for first, number in _windows(symbols):
                        total += np.bincount(number[inside[first : first + len(number)]], minlength=len(total)).astype(np.int32)
                    for _, number in spelled:
                        np.add.at(total, number, 1)
        for lang, total in sums.items():
            number = np.flatnonzero(total)
            for at in range(0, len(number), 100_000):
                part = number[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part.astype(np.int32)), pa.array(total[part].astype(np.int64))], names=["lang", "gram", "n"])

    return counted


def _wide(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, with borders as ``_symbols`` has them, their symbols, and where each text begins; the places where a gram of the table ends, and those where one with an escaped character does."""
    points, at = _code_points(texts)
    starts = at + ORDER * np.arange(len(at))
    wide = np.full(starts[-1], EDGE, np.int64)
    wide[np.arange(len(points)) + np.repeat(starts[:-1] - at[:-1] + ORDER - 1, np.diff(at))] = points
    symbols = table[np.minimum(wide, len(table) - 1)]
    symbols[wide == EDGE] = BORDER
    inside = np.ones(len(wide), bool)
    for k in range(ORDER - 1):
        inside[starts[:-1] + k] = False
    escaped = symbols == ESCAPE
    rare = escaped.copy()
    for k in range(1, ORDER):
        rare[k:] |= escaped[:-k]
    return wide, symbols, starts, inside & ~rare, np.flatnonzero(inside & rare)


def _tally(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The different rows of some columns, in order, and how often each is there."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    return [k[first] for k in keys], np.diff(np.append(first, len(order)))


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Some (history, symbol, count) as one, in which each gram is once."""
    history, symbol, n = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((symbol, history))
    history, symbol, n = history[order], symbol[order], n[order]
    first = np.flatnonzero(np.append(True, (history[1:] != history[:-1]) | (symbol[1:] != symbol[:-1]))[: len(n)])
    return history[first], symbol[first], np.add.reduceat(n, first) if len(n) else n


def _packed(wide: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """History and last character of the grams that end at some places."""
    return (wide[ends - 3] << 42) | (wide[ends - 2] << 21) | wide[ends - 1], wide[ends]


def _gram_counter(tables):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, history, symbol, code, count) of (lang, text, 1 if counted): all grams of counted texts, and of others those with an escaped
        character, 0 times, as their probability will be asked for. The code is the gram's symbols to the base ``SYMBOLS``."""
        own = tables.value
        sums: dict[str, np.ndarray] = {}
        rare: dict[str, list[tuple[np.ndarray, ...]]] = {}

        def batch_of(lang: str, history: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            code = np.zeros(len(n), np.int64)
            for part in (history >> 42, history >> 21 & WIDE - 1, history & WIDE - 1, symbol):
                code = code * SYMBOLS + np.where(part == EDGE, BORDER, own[lang][np.minimum(part, len(own[lang]) - 1)])
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(history, pa.int64()), pa.array(symbol, pa.int32()), pa.array(code, pa.int32()), pa.array(n, pa.int64())], names=["lang", "history", "symbol", "code", "n"])

        for whole in batches:
            for batch in steps(whole):
                for (lang, once), rows in _rows_by(pc.make_struct(batch.column(0), batch.column(2), field_names=["lang", "once"])).items():
                    wide, symbols, _, dense, ends = _wide(batch.column(1).take(pa.array(rows)), own[lang])
                    if once:
                        if lang not in sums:
                            sums[lang] = np.zeros(SYMBOLS**ORDER, np.int32)
                        for first, number in _windows(symbols):
                            np.add.at(sums[lang], number[dense[first : first + len(number)]], np.int32(1))  # a text has far fewer grams than there can be
                    parts = rare.setdefault(lang, [])
                    for at in range(0, len(ends), 100_000):
                        keys, n = _tally(*_packed(wide, ends[at : at + 100_000]))
                        parts.append((*keys, n * once))
                    if sum(len(x[2]) for x in parts) > TALLIED:
                        parts[:] = [_summed(parts)]
                        if len(parts[0][2]) > TALLIED // 2:
                            yield batch_of(lang, *parts.pop())
        for lang, parts in rare.items():
            if parts:
                yield batch_of(lang, *_summed(parts))
        for lang, total in sums.items():
            points = _points(own[lang])
            number = np.flatnonzero(total)
            for at in range(0, len(number), 100_000):
                part = number[at : at + 100_000]
                grams = np.stack([points[part // SYMBOLS**k % SYMBOLS] for k in range(ORDER - 1, -1, -1)], axis=1).reshape(-1)
                yield batch_of(lang, *_packed(grams, np.arange(ORDER - 1, len(grams), ORDER)), total[part])

    return counted


def _points(table: np.ndarray) -> np.ndarray:
    """The code point of each symbol; the border's is ``EDGE``, the escape has none."""
    out = np.full(SYMBOLS, EDGE, np.int64)
    known = np.flatnonzero(table > ESCAPE)
    out[table[known]] = known
    return out


def kneser_ney(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For orders 1 up to ``ORDER``: (lang, at, value) of discounted shares by gram, and of the weight of the lower order by history.

    ``counts`` has (lang, gram, n) of the highest order; a gram's number is its symbols to the base ``SYMBOLS``. Every
    aggregation and join is sharded by (lang, history); a level's counts are written before the next is made of them.
    """
    out = []
    now = counts
    for order in range(ORDER, 0, -1):
        base = now.withColumn("history", F.expr(f"gram div {SYMBOLS}"))
        tally = base.groupBy("lang").agg(*[F.sum(F.when(F.col("n") == k, 1).otherwise(0)).cast("double").alias(f"t{k}") for k in (1, 2, 3, 4)])
        y = F.when(F.col("t1") + 2 * F.col("t2") > 0, F.col("t1") / (F.col("t1") + 2 * F.col("t2"))).otherwise(F.lit(0.5))
        cut_of = lambda k: F.when(F.col(f"t{k}") > 0, F.least(F.greatest(k - (k + 1) * y * F.col(f"t{k + 1}") / F.col(f"t{k}"), F.lit(0.05)), F.lit(k - 0.05))).otherwise(F.lit(0.5 * k))
        discounts = tally.select("lang", *[cut_of(k).alias(f"d{k}") for k in (1, 2, 3)])
        discount = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        each = base.join(F.broadcast(discounts), "lang").withColumn("cut", discount)
        totals = each.groupBy("lang", "history").agg(F.sum("n").alias("total"), F.sum("cut").alias("mass"))
        joined = each.join(totals, ["lang", "history"])
        shares = joined.select("lang", F.col("gram").alias("at"), ((F.col("n") - F.col("cut")) / F.col("total")).alias("value"))
        out.append((shares, totals.select("lang", F.col("history").alias("at"), (F.col("mass") / F.col("total")).alias("value"))))
        if order > 1:  # how many different symbols stand before what is left when the first one goes
            now = cut(now.select("lang", F.expr(f"gram % {SYMBOLS ** (order - 1)}").alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n")))
    return out[::-1]


def log_tables(counts: DataFrame, langs: list[str]) -> dict[str, np.ndarray]:
    """Interpolated log probabilities of every possible n-gram: ``SYMBOLS ** ORDER`` halves a language.

    A table is built for one language after the other; the rows that are collected are as many as there can be n-grams at most.
    """
    return _filled([[_collected(x, langs) for x in level] for level in kneser_ney(counts)], langs, SYMBOLS, 1e-7)


def _filled(levels: list, langs: list[str], size: int, least: float) -> dict[str, np.ndarray]:
    """Tables of ``log_tables`` from collected levels; below order 1 each of ``size`` symbols is as likely."""
    out = {}
    for k, lang in enumerate(langs):
        if not (levels[-1][0][0] == k).any():
            continue
        lower = np.full(1, 1 / size, np.float32)
        for order, (shares, gammas) in enumerate(levels, 1):
            rest = SYMBOLS ** max(0, order - 2)
            gamma = np.ones(SYMBOLS ** (order - 1), np.float32)  # an unseen history says nothing
            own = gammas[0] == k
            gamma[gammas[1][own]] = gammas[2][own]
            if order == 1:
                table = np.full(SYMBOLS, gamma[0] / size, np.float32)
            else:
                table = (gamma.reshape(SYMBOLS, rest, 1) * lower.reshape(1, rest, SYMBOLS)).reshape(-1)
            own = shares[0] == k
            table[shares[1][own]] += shares[2][own]
            lower = table
        out[lang] = np.log(np.maximum(lower, least)).astype(np.float16)
    return out


def _collected(df: DataFrame, langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language's number, place, value) as arrays."""
    number = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1
    table = df.select(number.cast("byte").alias("k"), F.col("at").cast("int").alias("at"), F.col("value").cast("float").alias("value")).toArrow()
    return tuple(table.column(i).to_numpy() for i in range(3))


def _levels(grams: DataFrame) -> list[DataFrame]:
    """For orders 1 up to ``ORDER``: (lang, history, symbol, code, n) of each gram that was counted (n > 0) or is asked for (0), written once.

    Beyond order 1 each has its history's counts: their sum, how many are 1, 2 and more, and whether the row is the history's first. An
    order takes one exchange to sum up and one by history; discounts are worked out when all is written and need neither.
    """
    out: list[DataFrame] = []
    now = grams.repartition("lang", "history").groupBy("lang", "history", "symbol", "code").agg(F.sum("n").alias("n"))
    for order in range(ORDER, 0, -1):
        if order < ORDER:  # how many different symbols stand before what is left when the first one goes
            keys = ["lang", _rest(order + 1).alias("history"), "symbol", (F.col("code") % SYMBOLS**order).alias("code")]
            now = out[-1].select(*keys, F.when(F.col("n") > 0, 1).otherwise(0).alias("n")).groupBy("lang", "history", "symbol", "code").agg(F.sum("n").alias("n"))
        if order > 1:
            own = Window.partitionBy("lang", "history")
            many = lambda which: F.sum(F.when(which, 1).otherwise(0)).over(own)
            now = now.select("*", F.sum("n").over(own).alias("total"), many(F.col("n") == 1).alias("ones"), many(F.col("n") == 2).alias("twos"), many(F.col("n") > 2).alias("more"), (F.col("symbol") == F.min("symbol").over(own)).alias("lead"))
        out.append(cut(now))
    return out[::-1]


def _rest(order: int) -> Column:
    """The history of a gram of that order, without its first character."""
    return F.col("history").bitwiseAND(F.lit(WIDE ** (order - 2) - 1))


def _valued(levels: list[DataFrame], langs: list[str]) -> tuple[list[DataFrame], dict[str, float]]:
    """``levels`` with each gram's discounted share and the weight of the lower order behind its history; and that weight of order 1 by language."""
    each = [x.where("n > 0").select("lang", F.lit(order).alias("order"), "n") for order, x in enumerate(levels, 1)]
    some = lambda which: F.sum(F.when(which, 1).otherwise(0))
    sums = reduce(DataFrame.union, each).groupBy("lang", "order").agg(F.sum("n").alias("total"), some(F.col("n") > 2).alias("more"), *[some(F.col("n") == k).alias(f"t{k}") for k in (1, 2, 3, 4)])
    tally = {(r["lang"], r["order"]): r for r in sums.collect()}  # ORDER rows a language
    nothing = dict.fromkeys(("total", "more", "t1", "t2", "t3", "t4"), 0)
    by = lambda value: F.create_map(*[F.lit(x) for lang in langs for x in (lang, value[lang])])[F.col("lang")]
    out, base = [], {}
    for order, level in enumerate(levels, 1):
        t = {lang: tally.get((lang, order), nothing) for lang in langs}
        cuts = {lang: _cuts([x[f"t{k}"] for k in (1, 2, 3, 4)]) for lang, x in t.items()}
        d = [by({lang: x[k] for lang, x in cuts.items()}) for k in range(3)]
        if order == 1:
            base = {lang: sum(c * x[k] for c, k in zip(cuts[lang], ("t1", "t2", "more"))) / x["total"] if x["total"] else 1.0 for lang, x in t.items()}
            total, weight = by({lang: x["total"] for lang, x in t.items()}), by(base)
        else:
            total = F.col("total")
            weight = F.when(total > 0, (d[0] * F.col("ones") + d[1] * F.col("twos") + d[2] * F.col("more")) / total).otherwise(1.0)  # an unseen history says nothing
        own = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        out.append(level.withColumns({"share": F.when(F.col("n") > 0, (F.col("n") - own) / total).otherwise(0.0), "weight": weight}))
    return out, base


def _cuts(t: list[int]) -> list[float]:
    """Discounts of grams that are there once, twice and more often, from how many are there once to four times."""
    y = t[0] / (t[0] + 2 * t[1]) if t[0] + 2 * t[1] else 0.5
    return [min(max(k - (k + 1) * y * t[k] / t[k - 1], 0.05), k - 0.05) if t[k - 1] else 0.5 * k for k in (1, 2, 3)]


def _frequent(valued: list[DataFrame], base: dict[str, float], langs: list[str]) -> list[list[tuple[np.ndarray, ...]]]:
    """(language's number, place, value) of shares and weights of each order, of frequent characters only: at most as many as there are such grams."""
    number = F.array_position(F.array(*[F.lit(x) for x in langs]), F.col("lang")) - 1
    parts = []
    for order, df in enumerate(valued, 1):
        plain = [F.expr(f"code div {SYMBOLS**k} % {SYMBOLS} != {ESCAPE}") for k in range(order)]
        share = F.when(reduce(Column.__and__, plain) & (F.col("n") > 0), F.col("share"))
        weight = F.when(reduce(Column.__and__, plain[1:]) & F.col("lead") & (F.col("total") > 0), F.col("weight")) if order > 1 else F.lit(None)
        parts.append(df.select(F.lit(order).cast("byte").alias("order"), number.cast("byte").alias("k"), "code", share.cast("float").alias("share"), weight.cast("float").alias("weight")).where("share is not null or weight is not null"))
    table = reduce(DataFrame.union, parts).toArrow()
    order, out = table.column("order").to_numpy(), []
    for o in range(1, ORDER + 1):
        own = table.filter(pa.array(order == o))
        k, code = own.column("k").to_numpy(), own.column("code").to_numpy()
        share, weight = (own.column(x).to_numpy() for x in ("share", "weight"))
        has = [~np.isnan(share), ~np.isnan(weight)]
        weights = (k[has[1]], code[has[1]] // SYMBOLS, weight[has[1]]) if o > 1 else (np.arange(len(langs)), np.zeros(len(langs), np.int64), np.array([base[x] for x in langs], np.float32))
        out.append([(k[has[0]], code[has[0]], share[has[0]]), weights])
    return out


def _asked(valued: list[DataFrame]) -> DataFrame:
    """(lang, history, symbol, log) of grams with an escaped character, ``LOG_UNIT``s to one: each order's probability joined to the next one's grams."""
    for order, level in enumerate(valued, 1):
        if order == 1:
            now = level.select("lang", "history", "symbol", (F.col("share") + F.col("weight") / SIZE).alias("p"))
            continue
        if order == ORDER:
            level = level.where(reduce(Column.__or__, [F.expr(f"code div {SYMBOLS**k} % {SYMBOLS} = {ESCAPE}") for k in range(order)]))
        lower = now.select("lang", F.col("history").alias("rest"), "symbol", F.col("p").alias("lower"))
        now = level.withColumn("rest", _rest(order)).join(lower, ["lang", "rest", "symbol"]).select("lang", "history", "symbol", (F.col("share") + F.col("weight") * F.col("lower")).alias("p"))
    return now.select("lang", "history", "symbol", F.round(F.log("p") * LOG_UNIT).cast("long").alias("log"))


def _wide_scorer(tables, logs):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each document the log of its grams of frequent characters, and its other grams, to be joined."""
        own, known = tables.value, logs.value
        for whole in batches:
            for batch in steps(whole):
                total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
                found = [(np.zeros(0, np.int64),) * 3]
                for lang, rows in _rows_by(batch.column(1)).items():
                    wide, symbols, starts, dense, ends = _wide(batch.column(2).take(pa.array(rows)), own[lang])
                    log = known.get(lang)
                    count[rows] = np.diff(starts) - ORDER
                    if log is None:
                        total[rows] = np.nan
                        continue
                    for first, number in _windows(symbols):
                        place = np.flatnonzero(dense[first : first + len(number)])
                        owner = np.searchsorted(starts, place + first, "right") - 1
                        total[rows] += np.bincount(owner, weights=log[number[place]].astype(np.float64), minlength=len(rows))
                    found.append((rows[np.searchsorted(starts, ends, "right") - 1], *_packed(wide, ends)))
                (owner, history, symbol), n = _tally(*[np.concatenate(x) for x in zip(*found)])
                at = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(kind))) for x, kind in ((history, np.int64), (symbol, np.int32), (n, np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(total), pa.array(count), batch.column(3), *lists], names=["doc_id", "lang", "total", "n_chars", "trusted", "history", "symbol", "n"])

    return scored


def _scorer(tables, logs):
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = tables.value, logs.value
        for whole in batches:
            for batch in steps(whole):
                total, count = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
                for lang, rows in _rows_by(batch.column(1)).items():
                    symbols, starts, spelled = _symbols(batch.column(2).take(pa.array(rows)), own[lang])
                    log = known.get(lang)
                    count[rows] = np.diff(starts) - ORDER
                    if log is None:
                        total[rows] = np.nan
                        continue
                    inside = np.ones(len(symbols), bool)
                    for k in range(ORDER - 1):
                        inside[starts[:-1] + k] = False
                    for first, number in _windows(symbols):
                        place = np.flatnonzero(inside[first : first + len(number)])
                        owner = np.searchsorted(starts, place + first, "right") - 1
                        total[rows] += np.bincount(owner, weights=log[number[place]].astype(np.float64), minlength=len(rows))
                    for owner, number in spelled:
                        total[rows] += np.bincount(owner, weights=log[number].astype(np.float64), minlength=len(rows))
                value = np.exp(-total / (count + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value, mask=(count == 0) | np.isnan(total)), pa.array(count), batch.column(3)], names=["doc_id", "lang", "perplexity", "n_chars", "trusted"])

    return scored


def _scored(marked: DataFrame, langs: list[str], spelled: bool) -> DataFrame:
    """Each document's perplexity under its language's model: all of ``marked`` are of ``langs``."""
    spark = marked.sparkSession
    characters = marked.select("lang", "text").mapInArrow(_characters, "lang string, point int, n long").groupBy("lang", "point").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "point"))
    alphabet: dict[str, list[int]] = {x: [] for x in langs}
    for r in sorted(characters.withColumn("k", rank).where(F.col("k") <= DIGITS).collect(), key=lambda r: r["k"]):  # SYMBOLS rows a language at most
        alphabet[r["lang"]].append(r["point"])
    own = _symbol_tables(alphabet)
    tables = spark.sparkContext.broadcast(own)
    if spelled:
        counts = marked.where("trusted = 1").select("lang", "text").mapInArrow(_counter(tables), "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        logs = spark.sparkContext.broadcast(log_tables(cut(counts), langs))
        return cut(marked.select("doc_id", "lang", "text", "trusted").mapInArrow(_scorer(tables, logs), "doc_id long, lang string, perplexity double, n_chars long, trusted int"))
    counts = marked.select("lang", "text", (F.col("trusted") == 1).cast("int").alias("once")).mapInArrow(_gram_counter(tables), "lang string, history long, symbol int, code int, n long")
    valued, base = _valued(_levels(counts), langs)
    logs = spark.sparkContext.broadcast(_filled(_frequent(valued, base, langs), langs, SIZE, 1e-30))
    rows = cut(marked.select("doc_id", "lang", "text", "trusted").mapInArrow(_wide_scorer(tables, logs), "doc_id long, lang string, total double, n_chars long, trusted int, history array<long>, symbol array<int>, n array<int>")).withColumn("row", F.monotonically_increasing_id())
    rare = rows.select("row", "lang", F.explode(F.arrays_zip("history", "symbol", "n")).alias("g")).select("row", "lang", "g.*")
    sums = rare.join(_asked(valued), ["lang", "history", "symbol"]).groupBy("row").agg(F.sum(F.col("n") * F.col("log")).alias("log"))
    total = F.col("total") + F.coalesce(F.col("log") / LOG_UNIT, F.lit(0.0))
    perplexity = F.when((F.col("n_chars") > 0) & ~F.isnan("total"), F.exp(-total / (F.col("n_chars") + 1)))
    return cut(rows.drop("history", "symbol", "n").join(sums, "row", "left").select("doc_id", "lang", perplexity.alias("perplexity"), "n_chars", "trusted"))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "quality", quantile: float = QUANTILE, spelled: bool = False) -> DataFrame:
    """Each document's perplexity per character, its language's threshold (the ``quantile`` of held-out trusted documents), and whether it is kept.

    ``spelled``: a smaller model without joins, which knows of a rare character only its spelling, not what stands before and behind it.
    """
    trusted = cut(labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("long").alias("doc_id")).agg(F.avg(F.col(label).cast("double")).alias("q")).where("q >= 0.5").select("doc_id", F.when(F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT_OF)) == 0, 2).otherwise(1).alias("trusted")))
    few = trusted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("other")).alias("lang"), F.col(text).cast("string").alias("text"))
    marked = slim.join(F.broadcast(trusted.coalesce(8)) if few else trusted, "doc_id", "left").withColumn("trusted", F.coalesce("trusted", F.lit(0)))  # 0: not trusted, 1: counted, 2: held out
    known = [r["lang"] for r in marked.where("trusted > 0").groupBy("lang").count().where(F.col("count") >= LEAST_TRUSTED).orderBy("lang").collect()]  # languages
    parts = []
    for at in range(0, len(known), LANGUAGES_AT_ONCE):
        now = known[at : at + LANGUAGES_AT_ONCE]
        parts.append(_scored(marked.where(F.col("lang").isin(now)), now, spelled))
    rest = marked.where(~F.col("lang").isin(known)) if known else marked
    length = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    scored = rest.select("doc_id", "lang", F.lit(None).cast("double").alias("perplexity"), length.alias("n_chars"), "trusted")
    for part in parts:
        scored = scored.unionByName(part)
    at = lambda which: F.percentile_approx(F.when(which, F.col("perplexity")), quantile, 10_000)
    held = F.when(F.col("trusted") == 2, F.log("perplexity"))
    sums = scored.where("trusted > 0").groupBy("lang").agg(F.coalesce(at(F.col("trusted") == 2), at(F.lit(True))).alias("own"), F.count(held).alias("n"), F.avg(held).alias("mean"), F.stddev(held).alias("sd"))
    z = NormalDist().inv_cdf(quantile)
    student = z + (z**3 + z) / (4 * (F.col("n") - 1))  # Student's quantile, nearly
    bound = F.when(F.col("n").between(2, ENOUGH - 1), F.exp(F.col("mean") + student * F.col("sd") * F.sqrt(1 + 1 / F.col("n"))))
    limits = sums.select("lang", F.greatest("own", bound).alias("threshold"))
    out = scored.join(F.broadcast(limits), "lang", "left")
    kept = F.when(F.col("n_chars") == 0, F.lit(False)).otherwise(F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
    return out.select("doc_id", "lang", "perplexity", "threshold", kept.alias("kept"))
