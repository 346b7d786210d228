"""Corpus operators: brute force, exact round trips, held-out accuracy, and odd tables."""

import collections
import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, common, decontaminate, html_extract, license_scan, near_dedup, packing, quality_lm, quality_rules, tokens, toxicity, url_filter

WORDS = [a + b for a, b in itertools.product("ba ce di fo gu ha je ki lo mu".split(), "lan mer nos pit rus tal ven wok".split())]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and columns named like results."""
    rng = random.Random(0)
    long = prose(rng, 30_000)
    rows = [(None, None, None, None, None), (None, "", "en", "s", 0), (1, None, "en", None, 0), (1, None, "en", None, 0), (2, "", None, "s", 0), (3, "...\n\n \t ", "en", "s", 9), (4, "one", "zz", "s", 3), (5, long, "en", "s", 1), (5, long, "en", "s", 1), (None, long, "de", "s", 1), (6, "\U0001f600 é ﬁ İ" * 3, "fr", "s", 1)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("own") for c in ("score", "node", "kept", "component", "n_words", "labels", "class_id", "label", "_words", "host", "copy", "_id")})


# --- common ---------------------------------------------------------------------------------------------------------


def test_word_hashes(monkeypatch):
    rng = random.Random(1)
    alphabet = "aB9é, .\n…-_中"
    texts = ["", None, "a", " ", "Ab aB"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(300)]
    hashes, at = common.word_hashes(pa.array(texts))
    known = {}
    for t, a, b in zip(texts, at[:-1], at[1:]):
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        assert b - a == len(words)
        for w, h in zip(words, hashes[a:b].tolist()):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    monkeypatch.setattr(common, "SEGMENT_BYTES", 7)
    again, at2 = common.word_hashes(pa.array(texts))
    assert (again == hashes).all() and (at2 == at).all()


def test_steps_keep_every_row():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 0, 90, 1, 1, 40)] + [None])], names=["text"])
    parts = list(common.steps(batch, limit=10))
    assert sum(p.num_rows for p in parts) == 7 and pa.Table.from_batches(parts).to_pydict() == {"text": batch.column(0).to_pylist()}


# --- 1 --------------------------------------------------------------------------------------------------------------


def test_substituted_passages_are_found(spark):
    rng = random.Random(2)
    items = [prose(rng, n) for n in (40, 25, 16, 9, 4)]
    texts, want = [], set()
    for k in range(60):
        body = prose(rng, 200).split()
        if k % 2:
            i = rng.randrange(3)
            passage = items[i].split()
            for at in rng.sample(range(len(passage)), len(passage) // 10):
                passage[at] = "changed"
            body[50:50] = passage
            want.add((k, i))
        texts.append(" ".join(body).upper() + ".")
    texts += [f"start {items[3]} end", " ".join(items[4].split())]
    want.add((60, 3))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, texts)
    found = decontaminate.overlaps(docs, bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
    blocks = decontaminate.overlaps(docs, bench, block_bytes=100)
    assert {tuple(r) for r in blocks.collect()} == {tuple(r) for r in found.collect()}
    assert {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()} == set(range(62)) - {d for d, _ in want}


def test_overlap_spans_against_brute_force(spark):
    rng = random.Random(3)
    item = prose(rng, 30)
    text = f"{prose(rng, 50)} {item} {prose(rng, 50)}"
    row = decontaminate.overlaps(documents(spark, [text]), spark.createDataFrame([(7, item)], "item_id long, text string")).first()
    assert (row["doc_id"], row["item_id"], row["first_word"], row["n_words"], row["n_equal"]) == (0, 7, 50, 30, 30)


def test_every_passage_within_the_rule_gives_a_hit():
    """Brute force over all ways to change a quarter of 8 to 25 words, and over periods in longer passages."""
    masks = [(sum(1 << k for k, bit in enumerate(m) if bit == "1"), len(m)) for m in decontaminate.MASKS]

    def hit(words, equal):
        out = np.zeros(len(equal), bool)
        for mask, span in masks:
            for at in range(words - span + 1):
                out |= (equal >> at) & mask == mask
        return out

    for n in range(decontaminate.MIN_ITEM_WORDS, 2 * decontaminate.MIN_WORDS):
        changed = np.array([sum(1 << x for x in c) for c in itertools.combinations(range(n), int(n * (1 - decontaminate.MIN_EQUAL)))])
        assert hit(n, (1 << n) - 1 - changed).all()
    for n, period in itertools.product((16, 20, 30, 59), (4, 5, 6)):
        item = [f"w{k}" for k in range(n)]
        block = decontaminate.Block([(1, " ".join(item))])
        for phase in range(period):
            text = " ".join(["before"] * 3 + [f"x{k}" if k % period == phase else w for k, w in enumerate(item)])
            words, at = common.word_hashes(pa.array([text]))
            assert [tuple(x) for x in block.hits(words, at)] == [(0, 0, 3)]


def test_changes_anywhere_in_an_overlap(monkeypatch):
    """All stretches of every diagonal by brute force; changed words lie near the ends too."""
    monkeypatch.setattr(decontaminate, "STEP_WORDS", 100)
    rng = random.Random(21)
    items = [" ".join(f"i{k}w{j}" for j in range(n)) for k, n in enumerate([8, 9, 12, 13, 16, 20, 30, 59] * 3)]
    block = decontaminate.Block(list(enumerate(items)))
    texts, want = [], []
    for i, item in enumerate(items * 20):
        passage = item.split()
        for at in rng.sample(range(len(passage)), rng.randint(0, len(passage) // 3)):
            passage[at] = "changed"
        begin, end = (0, len(passage)) if i % 3 else sorted(rng.sample(range(len(passage) + 1), 2))
        equal = [False] * min(begin, 2) + [w != "changed" for w in passage[begin:end]] + [False] * min(len(passage) - end, 1)
        least = min(13, len(passage))
        want.append(any(sum(equal[a:b]) >= 0.75 * (b - a) for a in range(len(equal)) for b in range(a + least, len(equal) + 1)))
        texts.append(" ".join(["some", "words", *passage[begin:end], "after"]))
    words, starts = common.word_hashes(pa.array(texts))
    found = {}
    for k, item, diagonal in block.fitting(words, starts, block.hits(words, starts), 13, 0.75):
        found[k] = (item, block.overlap(words[starts[k] : starts[k + 1]], item, diagonal, 2.0, 13, 0.75))
    assert sorted(found) == [k for k, x in enumerate(want) if x] and 100 < len(found) < len(texts)
    for k, (item, (first, n, same)) in found.items():
        stretch = texts[k].split()[first : first + n]
        assert len(stretch) == n >= min(13, len(items[item].split())) and same >= 0.75 * n
        assert same == sum(w in items[item].split() for w in stretch)


# --- 2 --------------------------------------------------------------------------------------------------------------


def test_probabilities_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(quality_lm, "SYMBOLS", 6)
    rng = random.Random(0)
    text = [[0, 0, 0] + [rng.choice([2, 2, 3, 4]) for _ in range(20)] + [0] for _ in range(30)]
    counts = {}
    for t in text:
        for k in range(3, len(t)):
            g = ((t[k - 3] * 6 + t[k - 2]) * 6 + t[k - 1]) * 6 + t[k]
            counts[g] = counts.get(g, 0) + 1
    df = spark.createDataFrame([("en", g, n) for g, n in counts.items()], "lang string, gram int, n long")
    table = np.exp(quality_lm.log_tables(df, ["en"])["en"].astype(np.float64)).reshape(-1, 6)
    assert np.allclose(table.sum(axis=1), 1, atol=0.01)


def test_kneser_ney_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(quality_lm, "SYMBOLS", 5)
    rng = random.Random(1)
    grams = {}
    for _ in range(400):
        g = tuple(rng.choice([1, 1, 2, 3, 4]) for _ in range(4))
        grams[g] = grams.get(g, 0) + 1
    levels = {4: grams}
    for o in (3, 2, 1):
        levels[o] = {}
        for g in levels[o + 1]:
            levels[o][g[1:]] = levels[o].get(g[1:], 0) + 1

    def prob(g):
        if not g:
            return 1 / 5
        c = levels[len(g)]
        t = [sum(v == k for v in c.values()) for k in range(1, 5)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] + 2 * t[1] else 0.5
        d = [min(max(k - (k + 1) * y * t[k] / t[k - 1], 0.05), k - 0.05) if t[k - 1] else 0.5 * k for k in (1, 2, 3)]
        own = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        if not own:
            return prob(g[1:])
        total, mass = sum(own.values()), sum(d[min(v, 3) - 1] for v in own.values())
        share = (own[g] - d[min(own[g], 3) - 1]) / total if g in own else 0
        return share + mass / total * prob(g[1:])

    df = spark.createDataFrame([("en", ((g[0] * 5 + g[1]) * 5 + g[2]) * 5 + g[3], n) for g, n in grams.items()], "lang string, gram int, n long")
    table = quality_lm.log_tables(df, ["en"])["en"]
    for g in itertools.product(range(5), repeat=4):
        assert table[((g[0] * 5 + g[1]) * 5 + g[2]) * 5 + g[3]] == pytest.approx(np.log(prob(g)), abs=0.01)


def grams_of(text, table):
    """All grams of a text, and of the spelling of its rare characters, in plain Python."""
    codes = [int(table[c]) if c < len(table) else 1 for c in map(ord, text)]
    line = [0, 0, 0, *codes, 0]
    out = [tuple(line[k - 3 : k + 1]) for k in range(3, len(line))]
    for c in (ord(x) for x, code in zip(text, codes) if code == 1):
        d = [c // 46**k % 46 + 2 for k in range(4)][::-1]
        if c < quality_lm.SHORT:
            out += [(1, 0, 0, d[1]), (1, 0, d[1], d[2]), (0, *d[1:])]
        else:
            out += [(1, 0, 0, 0), (1, 1, 0, d[0]), (1, 0, d[0], d[1]), (0, *d[:3]), (0, *d[1:])]
    return [((g[0] * 48 + g[1]) * 48 + g[2]) * 48 + g[3] for g in out]


def test_counts_and_perplexity_against_plain_python():
    rng = random.Random(23)
    table = quality_lm._symbol_tables({"x": [ord(c) for c in "ab é中"]})["x"]
    texts = ["", None, "a", "中文 \U0001f600b"] + ["".join(rng.choice("ab é中文字\U0001f600Z") for _ in range(rng.randrange(30))) for _ in range(40)]
    plain = [grams_of(t or "", table) for t in texts]
    log = np.log(np.random.default_rng(0).random(quality_lm.SYMBOLS**quality_lm.ORDER) + 0.01).astype(np.float16)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(["x"] * len(texts)), pa.array(texts), pa.array([0] * len(texts))], names=["doc_id", "lang", "text", "trusted"])
    shared = lambda x: type("Value", (), {"value": {"x": x}})
    counts = {r["gram"]: r["n"] for b in quality_lm._counter(shared(table))(iter([batch.select(["lang", "text"])])) for r in b.to_pylist()}
    want = collections.Counter(g for p, t in zip(plain, texts) for g in p)
    assert counts == want
    got = [r for b in quality_lm._scorer(shared(table), shared(log))(iter([batch])) for r in b.to_pylist()]
    for r, p, t in zip(got, plain, texts):
        assert r["perplexity"] == (pytest.approx(np.exp(-sum(float(log[g]) for g in p) / (len(t) + 1))) if t else None)


def test_rare_characters_are_histories_too(spark):
    """Perplexity over a script of 120 characters, against a model of all characters in plain Python."""
    rng = random.Random(25)
    script = [chr(0x4E00 + 7 * k) for k in range(118)] + ["a", "\U0001f600"]
    follow = {c: rng.choices(script, k=3) for c in script}
    texts = []
    for k in range(40):
        text = [rng.choice(script)]
        while len(text) < 60:
            text.append(rng.choice(follow[text[-1]]))
        texts.append("".join(text if k % 4 else rng.sample(text, 60)))
    texts += [texts[1], "\u00e9" + texts[2], "", "a"]
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    got = {r["doc_id"]: r["perplexity"] for r in quality_lm.classify(documents(spark, texts), labels).collect()}
    held = {r["doc_id"] for r in labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(quality_lm.HELD_OUT_OF)) == 0).collect()}
    langs = {r["doc_id"]: r["lang"] for r in documents(spark, texts).select("doc_id", "lang").collect()}
    assert len(set(langs.values())) == 1
    grams_in = lambda t: [("^^^" + t + "^")[k : k + 4] for k in range(len(t) + 1)]
    levels = {4: collections.Counter(g for i in range(20) if i not in held for g in grams_in(texts[i]))}
    for o in (3, 2, 1):
        levels[o] = collections.Counter(g[1:] for g in levels[o + 1])
    cuts = {}
    for o, c in levels.items():
        t = [sum(v == k for v in c.values()) for k in range(1, 5)]
        y = t[0] / (t[0] + 2 * t[1]) if t[0] + 2 * t[1] else 0.5
        cuts[o] = [min(max(k - (k + 1) * y * t[k] / t[k - 1], 0.05), k - 0.05) if t[k - 1] else 0.5 * k for k in (1, 2, 3)]

    def prob(g):
        if not g:
            return 1 / (0x110000 + 1)
        d, c = cuts[len(g)], levels[len(g)]
        own = [v for x, v in c.items() if x[:-1] == g[:-1]]
        if not own:
            return prob(g[1:])
        share = c[g] - d[min(c[g], 3) - 1] if g in c else 0
        return (share + sum(d[min(v, 3) - 1] for v in own) * prob(g[1:])) / sum(own)

    for i, t in enumerate(texts):
        want = np.exp(-sum(np.log(prob(g)) for g in grams_in(t)) / (len(t) + 1)) if t else None
        assert got[i] == (pytest.approx(want, rel=0.005) if t else None)
    assert got[1] == got[40]


@pytest.mark.parametrize("tallied", [10, 1 << 18])
def test_grams_of_all_characters_against_plain_python(monkeypatch, tallied):
    """Every gram of counted texts, and 0 times those with a rare character that only other texts have."""
    monkeypatch.setattr(quality_lm, "TALLIED", tallied)
    rng = random.Random(26)
    table = quality_lm._symbol_tables({"x": [ord(c) for c in "ab é中"]})["x"]
    texts = ["", None, "a", "中文 \U0001f600b"] + ["".join(rng.choice("ab é中文字\U0001f600Z") for _ in range(rng.randrange(30))) for _ in range(60)]
    once = [k % 3 == 0 for k in range(len(texts))]
    want = collections.Counter()
    for t, counted in zip(texts, once):
        line = [quality_lm.EDGE] * 3 + [ord(c) for c in t or ""] + [quality_lm.EDGE]
        for k in range(3, len(line)):
            g = tuple(line[k - 3 : k + 1])
            codes = tuple(0 if c == quality_lm.EDGE else int(table[c]) if c < len(table) else 1 for c in g)
            if counted or 1 in codes:
                want[g, codes] += counted
    batches = [pa.RecordBatch.from_arrays([pa.array(["x"] * 8), pa.array(texts[k : k + 8]), pa.array([int(x) for x in once[k : k + 8]])], names=["lang", "text", "once"]) for k in range(0, len(texts), 8)]
    got = collections.Counter()
    for b in quality_lm._gram_counter(type("Value", (), {"value": {"x": table}}))(iter(batches)):
        for r in b.to_pylist():
            g = (*(r["history"] >> 21 * k & (1 << 21) - 1 for k in (2, 1, 0)), r["symbol"])
            got[g, tuple(r["code"] // 48**k % 48 for k in (3, 2, 1, 0))] += r["n"]
    assert got == want and set(got) == set(want) and 0 in want.values()


def test_tasks_of_the_quality_model_grow_slowly_with_partitions(spark):
    """Each task of an exchange leaves files however few its rows are, so they have to be few for each shuffle partition."""
    rng = random.Random(27)
    docs = documents(spark, [prose(rng, 40) + rng.choice("ÄÖÜ中文字") for _ in range(100)])
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    tracker, conf = spark.sparkContext.statusTracker(), {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}

    def job() -> int:
        spark.sparkContext.setJobGroup(name := f"tasks-{rng.random()}", "")
        spark.sparkContext.parallelize([1], 1).count()
        return max(tracker.getJobIdsForGroup(name))

    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        first = job()
        assert quality_lm.classify(docs, labels).count() == 100
        last = job()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    stages = {s for j in range(first + 1, last) for s in tracker.getJobInfo(j).stageIds}
    assert 40 < sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i) < 50 * 40


def test_every_language_has_a_model(spark, monkeypatch):
    """Ten languages, six at a time, one of them of a script with hundreds of characters; one without enough trusted texts."""
    monkeypatch.setattr(quality_lm, "LANGUAGES_AT_ONCE", 6)
    rng = random.Random(24)
    script = [chr(0x4E00 + rng.randrange(20_000)) for _ in range(300)]
    pairs = ["".join(rng.choices(script, k=2)) for _ in range(60)]
    rows = []
    for lang in [f"l{k}" for k in range(9)] + ["zh", "few"]:
        for k in range(60 if lang != "few" else 6):
            if lang == "zh":
                text = "".join(rng.choice(pairs) for _ in range(100)) if k < 50 else "".join(chr(0x4E00 + rng.randrange(20_000)) for _ in range(200))
            else:
                text = prose(rng, 60) if k < 50 else "".join(rng.choice("qxzj#%&!") for _ in range(300))
            rows.append((len(rows), text, lang, "s", k))
    labels = spark.createDataFrame([(i, 1) for i, _, lang, _, k in rows if k < (25 if lang != "few" else 3)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_lm.classify(spark.createDataFrame(rows, DOCS), labels).collect()}
    assert len(got) == len(rows) and all(got[i]["lang"] == lang for i, _, lang, _, _ in rows)
    kept = {lang: sum(got[i]["kept"] for i, _, x, _, k in rows if x == lang and k < 50) for lang in {r[2] for r in rows} - {"few"}}
    assert sum(kept.values()) >= 0.85 * 50 * len(kept) and min(kept.values()) >= 30  # five held-out texts a language set the threshold
    assert not any(got[i]["kept"] for i, _, lang, _, k in rows if lang != "few" and k >= 50)
    assert all(got[i]["kept"] and got[i]["perplexity"] is None and got[i]["threshold"] is None for i, _, lang, _, _ in rows if lang == "few")


def test_junk_is_told_from_prose(spark):
    rng = random.Random(4)
    texts = [prose(rng, 150) for _ in range(80)] + ["".join(rng.choice("qxzj#%&!") for _ in range(300)) for _ in range(8)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(84)], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in quality_lm.classify(documents(spark, texts), labels).collect()}
    assert sum(got[i] for i in range(80)) >= 74 and not any(got[i] for i in range(80, 90))


def test_threshold_is_the_quantile_of_held_out_texts(spark):
    rng = random.Random(22)
    docs = documents(spark, [prose(rng, 40) for _ in range(200)])
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    held = quality_lm.classify(docs, labels).where(F.pmod(F.xxhash64("doc_id"), F.lit(quality_lm.HELD_OUT_OF)) == 0).collect()
    assert len(held) >= quality_lm.ENOUGH and sum(not r["kept"] for r in held) == len(held) // 20


# --- 3 --------------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><head><title>t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><h2>Site name</h2></header><div id="cookie-notice"><p>We use cookies here</p></div><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="sidebar"><p>Other stories that you may like a lot more than this one here</p></div>
<article><h1>T&eacute;st &lt;b&gt;</h1><p>One two  three
four five.<p>Second <em>para</em>graph<br>line&nbsp;two<!-- no --><div class="ad">buy now</div><aside>beside it</aside><p>Third.</p>
<form><p>your name</p><input><button>go</button></form><section id="comments"><p>A reader says a lot about all of this and more</p></section></article>
<footer><p>&copy; us</p></footer>"""


def test_main_text_of_a_page():
    weights = html_extract.fit()
    assert html_extract.extract(PAGE, weights) == "Tést <b>\n\nOne two three four five.\n\nSecond paragraph line two\n\nThird."
    assert [html_extract.extract(x, weights) for x in (None, "", "<p></p>", "<!-- open", "<nav>a b</nav>")] == [""] * 5
    assert html_extract.extract("plain &amp; simple < 3", weights) == "plain & simple < 3"
    assert html_extract.extract('<div class="content"><p>real words stand here in a row</p></div><div class="comments"><p>no no no</p></div>', weights) == "real words stand here in a row"


def test_best_region_against_all_regions():
    rng = random.Random(40)
    for _ in range(300):
        scores = [rng.choice([1.0, 0.5, -0.5, -1.0, -2.0]) for _ in range(rng.randrange(30))]
        first, last, best = html_extract.best_region(scores)
        want = max([0.0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))])
        assert best == want == sum(scores[first:last])


TEXT = "real words of running text that go on for a while in a row "


@pytest.mark.parametrize("name", "reader-opinions feedback user-reviews kommentare outbrain toplinks commentlist cookieBanner sidebar_right newsletterbox".split())
def test_boilerplate_of_other_names(name):
    page = f'<div class="content"><p>{TEXT * 2}</p><div class="{name}"><p>BAD BAD BAD BAD</p></div><p>{TEXT}</p></div>'
    assert html_extract.extract(page, html_extract.fit()) == f"{TEXT * 2}".strip() + "\n\n" + TEXT.strip()


def test_all_articles_of_a_page_stay():
    weights = html_extract.fit()
    page = f"<nav><a>a</a></nav><article><h1>A</h1><p>{TEXT * 3}</p></article><div>between</div><article><h1>B</h1><p>{TEXT}</p></article><aside><article><p>{TEXT}</p></article></aside><footer>f</footer>"
    assert html_extract.extract(page, weights) == f"A\n\n{(TEXT * 3).strip()}\n\nB\n\n{TEXT.strip()}"
    assert html_extract.extract(f'<p>{TEXT}</p><div class="box"><p>three more words</p></div><p>{TEXT}</p>', weights) == f"{TEXT.strip()}\n\nthree more words\n\n{TEXT.strip()}"


@pytest.mark.parametrize("piece", ["<svg ", '<a b="', "<div>", "</p></x>", "<option>", "<svg>", "<article>", "<main><article>", "a<b ", "<!--", "<p class='ad'>", "<a b='\"", "&", "< ", "<select>", "</"])
def test_broken_markup_takes_linear_time(piece):
    weights = html_extract.fit()
    page = piece * ((1 << 20) // len(piece)) + f"<p>{TEXT}</p>"
    began = time.perf_counter()
    html_extract.extract(page, weights)
    assert time.perf_counter() - began < 4  # quadratic time would be minutes


def test_empty_table_of_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string, text string")
    got = html_extract.extract_pages(df)
    assert got.count() == 0 and got.columns == ["page_id", "url", "text", "n_chars"]


def test_pages_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, "y"), (1, "u", PAGE, "x")], "page_id long, url string, html string, n_chars string")
    got = html_extract.extract_pages(df).collect()
    assert len(got) == 3 and all(r["n_chars"] == len(r["text"]) for r in got)


def test_articles_of_the_given_pages(spark, sf):
    got = html_extract.extract_pages(spark.read.parquet(f"{sf}/pages.parquet")).collect()
    assert all(r["text"] and "<" not in r["text"] and "©" not in r["text"] for r in got)


# --- 4 --------------------------------------------------------------------------------------------------------------


def weighted_pairs(texts, factors):
    sets = []
    for t in texts:
        k, c, _ = near_dedup._shingle_sets(pa.array([t]))
        sets.append((k, c * factors[near_dedup._bucket(k)]))
    return {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if near_dedup.weighted_jaccard(sets[i], sets[j]) >= 0.8}


def families(rng, count, size, words=120):
    out = []
    for _ in range(count):
        base = prose(rng, words).split()
        for _ in range(size):
            copy = list(base)
            for at in rng.sample(range(words), rng.choice([0, 1, 1, 2, 3, 5])):
                copy[at] = f"w{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    return out


def classes_of(pairs, n):
    name = list(range(n))
    for a, b in sorted(pairs) * 10:
        name[a] = name[b] = min(name[a], name[b])
    return name


@pytest.mark.parametrize("block", [1024, 3])
def test_near_duplicates_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BROADCAST_NAMES", 10 if block == 3 else 1000)
    monkeypatch.setattr(near_dedup, "LINKS_AT_ONCE", 5 if block == 3 else 1000)
    rng = random.Random(6)
    texts = list(dict.fromkeys(families(rng, 6, 8) + [prose(rng, 80) for _ in range(40)] + families(rng, 1, 30)))
    docs = documents(spark, texts)
    factors = near_dedup.idf_table(docs)
    want = weighted_pairs(texts, factors)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    names = classes_of(want, len(texts))
    lost = sum(got[a] != got[b] for a, b in want)
    assert lost <= 0.01 * len(want)
    assert all(names[i] == names[got[i]] for i in got)


def sets_of(keys, rng):
    """Shingles, weights and bounds of sets that share most of ``keys``."""
    sets = [sorted(rng.sample(keys, rng.randint(len(keys) * 6 // 10, len(keys)))) for _ in range(40)]
    weights = {k: rng.uniform(1, 2) for k in keys}
    flat = np.array([k for x in sets for k in x], np.uint64)
    return sets, flat, np.array([weights[int(k)] for k in flat]), np.cumsum([0, *map(len, sets)])


@pytest.mark.parametrize("two", [False, True])
def test_joining_against_brute_force(two):
    """Components by all pairs; a pair of the same bucket in a lower band is left to that one."""
    for seed in range(5):
        rng = random.Random(seed)
        sets, flat, weights, at = sets_of(list(range(100, 160)), rng)
        sides = np.array([i % 2 if two else 0 for i in range(40)])
        probe = sides == 0
        parts = np.array([rng.randrange(30) for _ in range(40)])
        bands = np.array([[rng.randrange(6), 7, *range(i * 10, i * 10 + 10)] for i in range(40)])
        one = lambda i: (np.array(sets[i]), weights[at[i] : at[i + 1]])
        alike = {(i, k): near_dedup.weighted_jaccard(one(i), one(k)) for i, k in itertools.combinations(range(40), 2)}
        want = {p for p, x in alike.items() if x >= 0.7 and bands[p[0]][0] != bands[p[1]][0] and (not two or sides[p[0]] != sides[p[1]])}
        got = near_dedup.joining(1, sides, probe, parts, bands, flat, weights, at, 0.7)
        assert {(min(i, k), max(i, k)) for i, k, _ in got} <= want and all(abs(alike[min(i, k), max(i, k)] - x) < 1e-9 for i, k, x in got)
        first = [(i, int(np.flatnonzero(parts == p)[0])) for i, p in enumerate(parts)]
        assert classes_of([tuple(sorted(p)) for p in first] + sorted(want), 40) == classes_of([tuple(sorted(p)) for p in first] + [(min(i, k), max(i, k)) for i, k, _ in got], 40)
        assert len(got) < len(set(parts.tolist()))


def test_sets_are_packed_and_read_back():
    texts = ["a b c d e f g", "", "a a a a a a a a", "x"]
    table = pa.RecordBatch.from_arrays([pa.array([b"1", b"2", b"3", b"4"]), pa.array(texts)], names=["node", "text"])
    keys, counts, at = near_dedup._unpack([x for b in near_dedup._pack(iter([table])) for x in b.column(1).to_pylist()])
    want = near_dedup._shingle_sets(pa.array(texts))
    assert (keys == want[0]).all() and (counts == want[1]).all() and (at == want[2]).all() and 4 in counts


def test_one_family_of_hundreds(spark, capsys):
    """2,000 texts, 500 of them one family in which each copy is an edit of an earlier one: all links by brute force, and no pairs by the square."""
    rng = random.Random(31)
    family = [prose(rng, 200).split()]
    while len(family) < 500:
        copy = list(rng.choice(family[:80]))
        for at in rng.sample(range(200), rng.choice([1, 1, 2, 3])):
            copy[at] = f"w{rng.randrange(10**6)}"
        family.append(copy)
    texts = list(dict.fromkeys([" ".join(x) for x in family] + [prose(rng, 60) for _ in range(2000 - len(family))]))
    docs = documents(spark, texts)
    factors = near_dedup.idf_table(docs)
    want = weighted_pairs(texts[:500], factors)
    rows, named, links = near_dedup.classes(docs)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    lost = sum(got[a] != got[b] for a, b in want)
    with capsys.disabled():
        print(f" links {len(want)}, of them in one class {1 - lost / len(want):.4f}, verified as links {links.count()}")
    names = classes_of(want, len(texts))
    assert lost <= 0.002 * len(want) and all(names[i] == names[got[i]] for i in got)
    assert links.count() < 12 * 500


def test_copies_and_one_of_each(spark):
    rng = random.Random(7)
    texts = families(rng, 3, 6)
    docs = documents(spark, texts + texts[:5] + [None, "", "", "short", "short"])
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(docs).collect()}
    for k in range(5):
        assert got[18 + k]["class_id"] == got[k]["class_id"] and got[k]["n_copies"] >= 2
    assert got[23]["class_id"] == got[24]["class_id"] == 23 and got[27]["class_id"] == 26
    kept = near_dedup.one_of_each(docs.unionByName(docs))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, r in got.items() if r["kept"])
    assert kept.columns == docs.columns


def test_components_of_chains(spark):
    chain = [(i, i + 1) for i in range(0, 20)] + [(30, 31), (31, 30), (40, 50)]
    df = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in chain], "a binary, b binary")
    got = {r["node"][0]: r["component"][0] for r in near_dedup.components(df).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 40: 40, 50: 40}


def test_samples_estimate_similarity():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.choice(1 << 40, 300, replace=False)).astype(np.uint64)
    a, b = keys[:200], keys[100:]
    one = near_dedup.samples(np.concatenate([a, b]), np.ones(400), np.array([0, 200, 400]))
    assert abs((one[0] == one[1]).mean() - 1 / 3) < 0.2
    w = rng.uniform(0.5, 2, 200)
    same = near_dedup.samples(np.concatenate([a, a]), np.concatenate([w, w]), np.array([0, 200, 400]))
    assert (same[0] == same[1]).all()


# --- 5 --------------------------------------------------------------------------------------------------------------


def test_licences_against_brute_force():
    rng = random.Random(8)
    scanner = license_scan.Scanner()
    vocabulary = "under the mit license Apache License, Version 2 CC-BY NC 4.0 x é\n MIT".split(" ")
    for _ in range(300):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        places = [(i, x) for p, x in license_scan.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        got = scanner.scan(text)
        starts = [i for i, _ in places]
        assert got[:5] == (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
        assert set(got[4].split(",")) <= set(got[5].split(",")) or not got[4]


@pytest.mark.parametrize(
    "text, score, names",
    [
        ("MIT", 1.0, {"mit"}),
        ("GPL-3.0-only OR MIT", 1.0, {"gpl-3.0", "mit"}),
        ("MIT AND GPL-2.0-or-later", 0.4, {"mit", "gpl-2.0"}),
        ("MIT OR Apache-2.0 AND GPL-3.0", 1.0, {"mit", "apache-2.0", "gpl-3.0"}),
        ("(MIT OR Apache-2.0) AND GPL-3.0", 0.4, {"mit", "apache-2.0", "gpl-3.0"}),
        ("GPL-2.0 WITH Classpath-exception-2.0", 0.6, {"gpl-2.0-with-classpath-exception-2.0"}),
        ("MIT AND", 1.0, {"mit"}),
        ("", None, set()),
        (") MIT", None, set()),
        ("((MIT", 1.0, {"mit"}),
    ],
)
def test_expressions(text, score, names):
    got = license_scan.evaluate(license_scan.parse_expression(text))
    assert got[1] == names and (got[0] is None if score is None else got[0] == pytest.approx(score))


def test_tags_are_read():
    got = license_scan.Scanner().scan("// SPDX-License-Identifier: Apache-2.0 OR GPL-3.0\nint main")
    assert got[5] == "apache-2,gpl-3" and got[6] == 1.0
    for text in ("SPDX-License-Identifier: see file", "SPDX-License-Identifier:", "SPDX-License-Identifier: mitigation AND MIT"):
        assert license_scan.Scanner().scan(text)[5] == ""
    assert license_scan.Scanner().scan("Apache License, Version 2. SPDX-License-Identifier: Apache-2.0 see file")[5] == "apache-2"


# --- 6 --------------------------------------------------------------------------------------------------------------


def test_toxic_texts_of_held_out_rows(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model, keep=["doc_id"]).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows]) >= 0.95


def test_identity_terms_do_not_count():
    """Features 0 and 1 are terms of a group, of which 0 stands in most toxic texts; 2 is an insult."""
    rng = random.Random(9)
    rows, y = [], []
    for i in range(400):
        bad = i % 4 == 0
        term = 0 if rng.random() < (0.9 if bad else 0.5) else 1
        rows.append(np.array([term, 2] if i % 8 == 0 else [term]))
        y.append(float(bad))
    fit = lambda penalty: toxicity._fit(rows, np.array(y), 3, [np.array([0, 1])], [[np.array([0]), np.array([1])]], penalty, 1e-5, 0.25)[0]
    fair, biased = fit(10.0), fit(0.0)
    assert abs(fair[0] - fair[1]) < 0.1 < 0.5 < biased[0] - biased[1]
    assert fair[2] > 2


def test_pieces_of_identity_terms_do_not_count(spark):
    """Two groups stand in most toxic sentences, so their words and the pieces of these tell the classes apart; neutral mentions still score alike."""
    rng = random.Random(41)
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        term = rng.choice(["muslims", "muslim", "refugees"] if rng.random() < (0.9 if bad else 0.1) else ["christians", "christian", "locals"])
        rows.append((i, f"{prose(rng, 12)} {term} {prose(rng, 8)}{' grumplehead' if i % 6 == 0 else ''}", int(bad)))
    docs = documents(spark, [t for _, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    neutral = [f"the {x} of this town met" for x in ("muslims", "christians", "jews", "refugees", "locals", "immigrants")]
    fair, biased = (toxicity.train(docs, labels, counterfactual=c).scores(pa.array(neutral)) for c in (toxicity.COUNTERFACTUAL, 0.0))
    assert biased.max() - biased.min() > 0.4 and fair[:3].max() - fair[:3].min() < 0.1 and fair[3:].max() - fair[3:].min() < 0.1


@pytest.mark.parametrize("held", [1 << 18, 40])
def test_words_are_counted_by_class(monkeypatch, held):
    monkeypatch.setattr(toxicity, "_HELD", held)
    rng = random.Random(42)
    rows = [(rng.randrange(2), sorted(rng.sample(range(60), rng.randrange(30)))) for _ in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows]), pa.array([np.array(w, np.uint64).tobytes() for _, w in rows], pa.binary())], names=["label", "words"])
    got = collections.Counter()
    for part in toxicity._count(iter([batch.slice(0, 20), batch.slice(20)])):
        for r in part.to_pylist():
            got[r["word"], 0] += r["clean"]
            got[r["word"], 1] += r["toxic"]
    assert +got == collections.Counter((w, y) for y, words in rows for w in words)
    assert not list(toxicity._count(iter([])))


def test_pieces_do_not_cross_texts(monkeypatch):
    monkeypatch.setattr(toxicity, "_SEGMENT", 11)
    texts = ["abcdef", "gh", "ijklmn opqrst", "", None, "é€xyzw"]
    got = {}
    for owner, keys in toxicity.features(pa.array(texts)):
        for o, k in zip(owner.tolist(), keys.tolist()):
            if not k >> 63:
                got.setdefault(o, set()).add(k.to_bytes(5, "big"))
    want = {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        for k in range(len(raw) - 4):
            w = raw[k : k + 5]
            if b" " not in w[1:]:
                want.setdefault(i, set()).add(w)
    assert got == want


# --- 7 --------------------------------------------------------------------------------------------------------------


def measures(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


def test_rules_against_brute_force(spark):
    rng = random.Random(10)
    texts = ["", "a", " \n\t", "a\x0bb\x0cc\rd", "x" * 50] + [rng.choice(["", " ", "\n"]).join(rng.choice(["a", "b ", "c\n", "d#|", "\n\n", "é "]) for _ in range(rng.randrange(60))) for _ in range(300)]
    got = quality_rules.judge(documents(spark, texts)).collect()
    for r in got:
        want = measures(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_rules_plan_is_native(spark):
    plan = quality_rules.judge(documents(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_rules_keep_prose_and_drop_junk(spark):
    clean = "The house by the river was old, and nobody in the town knew who had built it or why it stood so far from the road."
    junk = [clean.upper().replace(" ", "!! "), " | ".join(clean.split()), clean.replace(" ", "*** "), "spam " * 40]
    got = [r["kept"] for r in quality_rules.judge(documents(spark, [clean, *junk])).orderBy("doc_id").collect()]
    assert got == [True] + [False] * 4
    assert [r["text"] for r in quality_rules.passing(documents(spark, [clean, *junk])).collect()] == [clean]


# --- 8 --------------------------------------------------------------------------------------------------------------


def test_ids_are_the_tokenizers_own(monkeypatch):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    whole = Tokenizer.from_file(path)
    rng = random.Random(11)
    alphabet = "ab'.,!1 é́…\nİßΣ中 \x1c<|>#sTLl"
    texts = ["", None, "<|endoftext|> x", "don't I'LL", "x" * 3000, "\ufeffhi ﬁ"] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for _ in range(2000)]
    signs = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", " ", "a", "é", "hello", "\n"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randrange(8))) for _ in range(300)]
    encoder = tokens.UnitEncoder(path)
    for limit, segment in ((10**6, 1 << 20), (300, 64)):
        monkeypatch.setattr(tokens, "TABLE_UNITS", limit)
        monkeypatch.setattr(tokens, "SEGMENT_BYTES", segment)
        ids, at = encoder.encode(pa.array(texts))
        for t, a, b in zip(texts, at[:-1], at[1:]):
            assert ids[a:b].tolist() == whole.encode(t or "", add_special_tokens=False).ids


def test_packing_is_whole_and_gapless(spark):
    from tokenizers import Tokenizer

    rng = random.Random(12)
    texts = [prose(rng, rng.choice([0, 3, 30, 200])) for _ in range(150)] + [None, prose(rng, 900)]
    got = [r.asDict() for r in packing.pack(documents(spark, texts), capacity=256, open_bins=8, with_ids=True).collect()]
    whole = Tokenizer.from_file(packing.vocabulary_path())
    for i, t in enumerate(texts):
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["piece"])
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        assert [x for r in own for x in r["ids"]] == ids and [r["start"] for r in own] == list(range(0, len(ids), 256))
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) for r in own)
    for _, part in itertools.groupby(sorted(got, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in part:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert len({r["sequence_id"] for r in got}) <= 1.15 * -(-sum(r["length"] for r in got) // 256) + 1


def test_best_fit_against_plain_search():
    rng = random.Random(13)
    bins, plain, made = packing.OpenBins(64, 5), {}, 0
    for _ in range(3000):
        n = rng.randint(1, 64)
        number, offset = bins.put(n)
        fits = [s for s in plain.values() if s >= n]
        if fits:
            assert offset == 64 - min(fits) and plain[number] == min(fits)
        else:
            if len(plain) >= 5:
                fullest = min(plain.values())
                gone = [k for k, s in plain.items() if s == fullest and k not in [x for v in bins.by_space for x in v] and k != number]
                del plain[gone[0]]
            assert offset == 0 and number == made
            made += 1
            plain[number] = 64
        plain[number] -= n
        if not plain[number]:
            del plain[number]
        assert len(plain) <= 5


# --- 9 --------------------------------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    rng = random.Random(14)
    pieces = ["<|im_end|>", "<|im_start|>", "<\\|", "<\\\\|x", "assistant", "\n", "é", "<", "|", "\\", "ok"]
    turns = [(c, t, rng.choice(["user", "assistant", "system", "a\nb\\n<|", None]), rng.choice([None, "".join(rng.choice(pieces) for _ in range(rng.randrange(8)))])) for c in range(40) for t in range(rng.randrange(1, 6))]
    turns += [(None, None, "user", "x"), (None, None, "user", "x")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(5)
    formatted = chat_format.format_turns(df)
    for r in formatted.collect():
        body = r["formatted"].removeprefix("<|im_start|>").removesuffix("<|im_end|>\n")
        assert "<|" not in body
    got = {r["conv_id"]: r for r in chat_format.read_back(formatted).collect()}
    for c in [*range(40), None]:
        own = sorted((t for t in turns if t[0] == c), key=lambda t: t[1] if t[1] is not None else -1)
        digest = hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own).encode()).hexdigest()
        learned = "".join(t or "" for _, _, r, t in own if r == "assistant")
        g = got[c]
        assert (g["n_turns"], g["turns_sha256"], g["loss_chars"], g["loss_sha256"]) == (len(own), digest, len(learned), hashlib.sha256(learned.encode()).hexdigest())


# --- 10 -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "url, host, path, rule, verdict",
    [
        (None, "", "", None, "allow"),
        ("example.net/en/1", "", "", None, "allow"),
        ("HTTP://A.Example.NET/en/1?x#y", "a.example.net", "/en/1", "example.net/en/", "allow"),
        ("http://other.net/x", "other.net", "/x", "net/", "block"),
        ("http://other.net", "other.net", "", None, "allow"),
        ("http://myexample.com/de/1", "myexample.com", "/de/1", None, "allow"),
        ("http://www.example.com/de/1", "www.example.com", "/de/1", "example.com/de/", "block"),
        ("x://casino-win.example.org/fr/9", "casino-win.example.org", "/fr/9", "org/fr/", "allow"),
        ("https://casino-win.example.org/en/9", "casino-win.example.org", "/en/9", None, "block"),
        ("http://h?q=/de/", "h", "", None, "allow"),
    ],
)
def test_urls(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(1, url, "own")], "page_id long, url string, host string")
    r = url_filter.judge_urls(df).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_held_out_accuracy(capsys):
    """Ten folds; the hyphens of held-out hosts are taken out, so that the words have to be found."""
    lists = url_filter.labelled()
    right = unknown = 0
    for fold in range(10):
        model = url_filter.fit(*[[u for i, u in enumerate(own) if i % 10 != fold] for own in lists])
        for verdict, own in zip(("block", "allow"), lists):
            for u in own[fold::10]:
                host, _, path = u.partition("/")
                score = model.score(host.replace("-", ""), path)
                right += model.verdict(score) == verdict
                unknown += score is None
    n = sum(map(len, lists))
    with capsys.disabled():
        print(f" URLs held out {n}, right {right / n:.3f}, without a known word {unknown}")
    assert right >= 0.9 * n


def test_naive_bayes_against_its_definition():
    model = url_filter.fit(["bad-slots.test/", "bad-pills.test/"], ["good-books.test/", "good-slots.test/"], words=())
    blocked, allowed, vocab = {"bad": 2, "slots": 1, "pills": 1}, {"good": 2, "books": 1, "slots": 1}, 5
    for w in ("bad", "good", "slots", "pills", "books"):
        assert model.weights[w] == pytest.approx(np.log((blocked.get(w, 0) + 0.5) / (4 + 0.5 * vocab)) - np.log((allowed.get(w, 0) + 0.5) / (4 + 0.5 * vocab)))
    assert model.score("badslots.com", "") == pytest.approx(model.weights["bad"] + model.weights["slots"]) and model.score("unheard.com", "/1") is None


def test_words_of_all_pages(spark):
    urls = [f"http://h{k}.garden{'x' * k}.test/seed/{k}" for k in range(4)] * 2 + ["http://one.test/only/only", None, "no url", "http://"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    assert url_filter.corpus_words(df) == {"seed": 8, "test": 9}
    assert url_filter.fit(seen={"zebracorn": 50}).segmenter.split("bigzebracornnews") == ["big", "zebracorn", "news"]
    empty = url_filter.judge_urls(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "host", "path", "rule", "verdict", "score", "host_words"]


def test_viterbi_against_all_cuts():
    model = url_filter.fit().segmenter
    rng = random.Random(15)
    words = [w for w in model.log if len(w) < 6]

    def cost(parts):
        return sum(model.log.get(p, model.unknown + model.per_char * len(p)) for p in parts)

    for _ in range(40):
        name = ("".join(rng.choice(words + ["zq", "xkr"]) for _ in range(3)))[:11]
        best = min(cost([name[a:b] for a, b in zip((0, *cuts), (*cuts, len(name)))]) for k in range(len(name)) for cuts in itertools.combinations(range(1, len(name)), k))
        assert cost(model.split(name)) == pytest.approx(best)


# --- odd tables -----------------------------------------------------------------------------------------------------


def test_odd_tables(spark, odd):
    bench = spark.createDataFrame([(1, None), (None, ""), (2, "too short")], "item_id long, text string")
    labels = spark.createDataFrame([(None, 1, 1), (1, None, None), (5, 1, 0), (4, 0, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    n = odd.count()
    for docs in (odd, odd.limit(0)):
        size = n if docs is odd else 0
        assert decontaminate.overlaps(docs, bench).count() == 0
        assert decontaminate.clean(docs, bench).count() == size
        assert decontaminate.clean(docs, bench.limit(0)).columns == odd.columns
        assert quality_lm.classify(docs, labels).count() == size
        assert near_dedup.near_duplicates(docs).count() == size
        assert license_scan.scan_licenses(docs).count() == size
        assert quality_rules.judge(docs).count() == size
        model = toxicity.train(docs, labels)
        assert toxicity.score(docs, model).where("score between 0 and 1").count() == size
        assert packing.pack(docs).select("doc_id", "copy").distinct().count() == size
    assert quality_lm.classify(odd, labels.limit(0)).count() == n
    assert toxicity.score(odd, toxicity.train(odd, labels.limit(0))).count() == n


def test_stages_on_odd_documents(spark, odd, sf):
    import corpus_pipeline

    docs = odd.select(*corpus_pipeline.COLUMNS, F.lit(1).alias("extra"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_pipeline_against_its_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, sf).collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if measures(r["text"])[0] >= 10} & {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
    out = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert out and out < kept
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    left = docs.where(F.col("doc_id").isin(sorted(out)))
    assert decontaminate.overlaps(left, bench).count() == 0
    classes = near_dedup.near_duplicates(left).select("class_id").distinct().count()
    assert classes == len(out)
