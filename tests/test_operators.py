"""Operators against literal expectations and plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import bits, taxonomy, text, vectors
from tessera.operators import aliases, cooccur, dedup, images, losses, prefix, quota, reconcile, sampling, scoring, spatial, store, survey, training, vocabulary


def bag(spark, items):
    return spark.createDataFrame([(i, t) for i, tags in enumerate(items) for t in tags], "item long, tag string")


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- taxonomy -------------------------------------------------------------------------------------------------------


def test_identity_and_raw_name(spark):
    df = spark.createDataFrame([(c,) for c in (0, 1, 2, 3, 4, 5, 6, 999)], "code int").withColumn("name", taxonomy.identity(F.lit("x"), taxonomy.category_of(F.col("code"))))
    got = dict(values(df, "code", "name"))
    assert got == {0: "x", 1: "artist:x", 2: "x", 3: "series:x", 4: "character:x", 5: "meta:x", 6: "x", 999: "x"}
    raw = df.select(taxonomy.raw_name(F.col("name")).alias("r")).distinct().collect()
    assert [r["r"] for r in raw] == ["x"]


def test_exclusion_precedence(spark):
    rules = taxonomy.ExclusionRules.parse(["# a comment", "", "plain", "meta:both", "!meta:both", " !meta:kept "])
    df = spark.createDataFrame([("meta:x",), ("meta:pen_(medium)",), ("meta:both",), ("meta:kept",), ("plain",), ("other",)], "name string")
    got = dict(values(df.withColumn("e", rules.excluded(F.col("name"))), "name", "e"))
    assert got == {"meta:x": True, "meta:pen_(medium)": False, "meta:both": False, "meta:kept": False, "plain": True, "other": False}
    assert taxonomy.ExclusionRules.parse(rules.lines()) == rules


# --- surveys --------------------------------------------------------------------------------------------------------


def listing(spark, rows):
    return spark.createDataFrame([(s, r, c, n, k) for k, (s, r, c, n) in enumerate(rows)], "site string, raw string, category string, n long, pos long")


def test_merge_prefers_first_site(spark):
    none = spark.createDataFrame([], "raw string, canonical string")
    out = survey.merge_sites(listing(spark, [("a", "elvaan", "general", 1000), ("b", "elvaan", "character", 2000), ("b", "frieren", "character", 500)]), none)
    assert sorted((r["name"], r["count_a"], r["count_b"]) for r in out.collect()) == [("character:frieren", None, 500), ("elvaan", 1000, 2000)]


def test_merge_folds_aliases(spark):
    closed = aliases.closure(spark.createDataFrame([("head_pat", "headpat")], "antecedent string, consequent string"))
    out = survey.merge_sites(listing(spark, [("a", "headpat", "general", 23846), ("b", "head_pat", "general", 1020)]), closed)
    assert [(r["name"], r["count_a"], r["count_b"]) for r in out.collect()] == [("headpat", 23846, 1020)]


def test_take_while_stops_for_good(spark):
    df = listing(spark, [("a", "x", "general", 9), ("a", "y", "general", 4), ("a", "z", "general", 8), ("b", "w", "general", 3)])
    assert values(survey.take_while(df, 5), "raw") == [("x",)]


def test_closure_against_walk(spark):
    rng = random.Random(3)
    table = {f"n{a}": f"n{rng.randrange(40)}" for a in rng.sample(range(40), 30)}

    def walk(x):
        seen, now = set(), x
        while now in table and now not in seen:
            seen.add(now)
            now = table[now]
        return now

    df = spark.createDataFrame(list(table.items()), "antecedent string, consequent string")
    assert dict(values(aliases.closure(df), "raw", "canonical")) == {a: walk(a) for a in table}


def test_first_site_wins_alias_union(spark):
    a, b = (spark.createDataFrame([("head_pat", x, 0)], "antecedent string, consequent string, pos long") for x in ("headpat", "petting"))
    assert values(aliases.union_by_priority(a, b), "antecedent", "consequent") == [("head_pat", "headpat")]


def test_higher_count_owns_raw_name(spark):
    tags = spark.createDataFrame([("elvaan", 1000), ("character:elvaan", 2000)], "name string, best_count long")
    empty = spark.createDataFrame([], "antecedent string, consequent string")
    assert values(aliases.eligible_identities(tags, empty), "raw", "identity") == [("elvaan", "character:elvaan")]


# --- co-occurrence --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "items, target, want",
    [
        ([("0", "1")] * 60 + [("1", "2")] * 40, "0", [("1", 1.0, 40)]),
        ([("0", "1")] * 100 + [("0",)] * 400, "0", []),
        ([("0", "1")] * 100 + [("0",)] * 400, "1", [("0", 1.0, 400)]),
        ([("0", "1")] * 10 + [("0",)] * 90 + [("1",)] * 990, "0", []),
        ([("0", "1")] * 50 + [("1",)] * 2, "0", []),
        ([("0", "1", "2")] * 60 + [("0", "1")] * 40 + [("1",)] * 20 + [("2",)] * 20, "0", [("1", 1.0, 20), ("2", 0.6, 20)]),
    ],
)
def test_hard_negatives(spark, items, target, want):
    out = cooccur.hard_negative_sources(bag(spark, items), 0.5, 15).where(F.col("tag") == target).orderBy("rank")
    assert [(r["other"], r["ratio"], r["counter"]) for r in out.collect()] == want


def test_negative_plan_ends_with_background(spark):
    items = [("character:miku", "series:vocaloid")] * 60 + [("series:vocaloid", "x")] * 40
    bags = bag(spark, items)
    plan = cooccur.negative_query_plan(spark.createDataFrame([("character:miku",), ("new",)], "tag string"), bags, 0.5, 15, 3).orderBy("tag", "step")
    assert [(r["tag"], r["query"], r["phase"]) for r in plan.collect()] == [("character:miku", "vocaloid -miku", "negative:cooccur:series:vocaloid"), ("character:miku", "-miku", "negative"), ("new", "-new", "negative")]


# --- quotas ---------------------------------------------------------------------------------------------------------


def test_quota_columns(spark):
    df = spark.createDataFrame([(0, 1000), (999, 1000), (1000, 1000), (1500, 1000)], "n int, m int")
    assert [r[0] for r in df.select(quota.keeps_fetching(F.col("n"), F.col("m"))).collect()] == [True, True, False, False]
    row = spark.range(1).select(quota.negative_shortfall(F.lit(10), F.lit(4), 8), quota.negative_shortfall(F.lit(100), F.lit(4), 8), quota.site_floor(1, 2), quota.site_floor(1001, 2)).first()
    assert list(row) == [2, 0, 1, 501]


@pytest.mark.parametrize("given, want", [([1, 1, 1], [False, False, True]), ([1, 1, 0.5, 0.5, 0.5], [False] * 4 + [True])])
def test_early_stopping(spark, given, want):
    df = spark.createDataFrame([(0, k, float(x)) for k, x in enumerate(given)], "run int, step long, loss double")
    assert [r["stops"] for r in quota.early_stopping(df, patience=2).orderBy("step").collect()] == want


# --- duplicates -----------------------------------------------------------------------------------------------------


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("distance", [0, 1, 2, 4])
def test_hamming_pairs_against_brute_force(spark, distance):
    rng = random.Random(distance)
    hashes = [rng.getrandbits(64) for _ in range(80)]
    hashes += [h ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6))) for h in hashes]
    df = spark.createDataFrame([(k, signed(h)) for k, h in enumerate(hashes)], "item long, h long")
    want = [(a, b, (hashes[a] ^ hashes[b]).bit_count()) for a in range(160) for b in range(a + 1, 160) if (hashes[a] ^ hashes[b]).bit_count() <= distance]
    assert values(dedup.hamming_pairs(df, distance), "a", "b", "distance") == want


def test_large_buckets_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BUCKET", 4)
    rng = random.Random(9)
    hashes = [rng.getrandbits(8) for _ in range(60)]
    df = spark.createDataFrame([(k, h) for k, h in enumerate(hashes)], "item long, h long")
    want = [(a, b) for a in range(60) for b in range(a + 1, 60) if (hashes[a] ^ hashes[b]).bit_count() <= 2]
    assert values(dedup.hamming_pairs(df, 2), "a", "b") == want


def test_leaders_against_sequential_walk(spark):
    rng = random.Random(5)
    hashes = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(90):
        hashes.append(rng.choice(hashes) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))))
    edges = [0, 21, 42, 64]
    leading, want = [], {}
    for k, h in enumerate(hashes):
        near = [j for j in leading if (hashes[j] ^ h).bit_count() <= 2]
        if near:
            band = lambda j: min(b for b in range(3) if not ((hashes[j] ^ h) >> edges[b]) & ((1 << (edges[b + 1] - edges[b])) - 1))  # noqa: E731, B023
            want[k] = min(near, key=lambda j: (band(j), j))
        else:
            leading.append(k)
            want[k] = k
    df = spark.createDataFrame([(k, signed(h)) for k, h in enumerate(hashes)], "item long, h long")
    assert dict(values(dedup.leaders(df, 2), "item", "leader")) == want


def test_hash_bits(spark):
    v = np.random.default_rng(0).normal(size=64)
    want = signed(int("".join("1" if x > np.median(v) else "0" for x in v), 2))
    assert spark.createDataFrame([(v.tolist(),)], "v array<double>").select(bits.median_hash(F.col("v")).alias("h")).first()["h"] == want
    assert spark.range(1).select(bits.hamming(F.lit(-1), F.lit(0))).first()[0] == 64


# --- reconciliation -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "current, snaps, seen, tags, delta",
    [
        (["1girl"], [("a", ["1girl"]), ("b", ["1girl"])], [("b", ["outdoors"])], ["1girl", "outdoors"], {"outdoors": 1}),
        (["1girl"], [("a", []), ("b", ["1girl"])], [("b", ["outdoors"])], ["outdoors"], {"outdoors": 1, "1girl": -1}),
        (["1girl"], [("a", ["1girl"]), ("b", ["1girl"])], [("a", None), ("b", None)], [], {"1girl": -1}),
        (["1girl"], [("a", None), ("b", ["1girl"])], [("b", [])], ["1girl"], {}),
    ],
)
def test_reconcile(spark, current, snaps, seen, tags, delta):
    made = lambda rows, schema: spark.createDataFrame(rows, schema)
    out = reconcile.reconcile(made([(1, current)], "item long, tags array<string>"), made([(1, *s) for s in snaps], "item long, source string, tags array<string>"), made([(1, *s) for s in seen], "item long, source string, tags array<string>"))
    assert out.first()["tags"] == tags
    assert dict(values(reconcile.deltas(out), "tag", "delta")) == delta


# --- samples --------------------------------------------------------------------------------------------------------


def test_prefix_sum_and_numbers(spark):
    rng = random.Random(1)
    keys = rng.sample(range(10_000), 300)
    df = spark.createDataFrame([(k, k % 7) for k in keys], "k long, v long")
    total, want = 0, {}
    for k in sorted(keys):
        want[k] = total
        total += k % 7
    assert dict(values(prefix.prefix_sum(df, "k", F.col("v"), chunk=16), "k", "before")) == want
    assert dict(values(prefix.dense_number(df, "k"), "k", "row_index")) == {k: i for i, k in enumerate(sorted(keys))}


def test_first_n_by_hash_is_exact(spark):
    import hashlib

    df = spark.range(500).withColumnRenamed("id", "item")
    order = sorted(range(500), key=lambda i: (hashlib.md5(f"s{i}".encode()).hexdigest(), i))
    for n in (0, 1, 37, 500, 900):
        assert values(prefix.first_n_by_hash(df, "item", n, "s"), "item") == sorted((i,) for i in order[:n])


def test_coverage_against_walk(spark):
    rng = random.Random(2)
    items = [tuple({f"t{min(rng.randrange(12), rng.randrange(12))}" for _ in range(3)}) for _ in range(150)]
    df = bag(spark, items).withColumn("pos", F.col("item"))
    for most, per in ((40, 3), (12, 1), (150, 2)):
        by = {}
        for k, tags in enumerate(items):
            for t in tags:
                by.setdefault(t, []).append(k)
        order = sorted(by, key=lambda t: (len(by[t]), by[t][0], t))
        taken = set(range(150)) if most >= 150 else set()
        for t in order:
            for k in [k for k in by[t] if k not in taken][: max(0, min(per, most - len(taken)))]:
                taken.add(k)
        for k in range(150):
            if len(taken) < most:
                taken.add(k)
        assert values(sampling.coverage(df, most, per), "item") == sorted((k,) for k in taken)


def test_balanced_sizes(spark):
    items = [("x",)] * 10 + [("y",)] * 50
    for cap, want in ((None, 10), (3, 3)):
        got = values(sampling.balanced(bag(spark, items), ["x"], cap), "positive", "item")
        assert sum(p for p, _ in got) == want and len(got) == 2 * want
        assert all(i < 10 for p, i in got if p)


def test_rare_items_are_drawn_more(spark):
    weights = spark.createDataFrame([(0, 0.001), (1, 1.0)], "item long, weight double")
    draws = spark.range(100).select(F.col("id").alias("draw"), ((F.col("id") + 0.5) / 100).alias("u"))
    got = values(sampling.weighted_draws(weights, draws), "draw", "item")
    assert len(got) == 100 and sum(i for _, i in got) >= 99


@pytest.mark.parametrize("n, want", [(1, 0), (2, 1), (10, 1), (100, 10)])
def test_split_sizes(spark, n, want):
    df = spark.range(n).withColumnRenamed("id", "item")
    assert sampling.train_split(df, 0.1).where("validation").count() == want


# --- vocabulary and storage -----------------------------------------------------------------------------------------


def test_replay_last_wins(spark):
    base = spark.createDataFrame([(0, "solo", 5, "Trained"), (1, "1girl", 2, "Trained")], "row_index long, tag string, image_count long, status string")
    log = spark.createDataFrame([(0, "new", 1, "WarmStartOnly"), (1, "solo", 7, "Trained"), (2, "new", 3, "Trained")], "line long, tag string, image_count long, status string")
    assert values(vocabulary.replay(base, log), "row_index", "tag", "image_count", "status") == [(0, "solo", 7, "Trained"), (1, "1girl", 2, "Trained"), (2, "new", 3, "Trained")]


def test_promotion(spark):
    df = spark.createDataFrame([("a", 5, "WarmStartOnly"), ("b", 10, "WarmStartOnly")], "tag string, image_count long, status string")
    assert values(vocabulary.promote(df, 10), "tag", "status") == [("a", "WarmStartOnly"), ("b", "Trained")]


def test_table_commits_once(spark, tmp_path):
    table = store.Table(spark, str(tmp_path / "t"))
    rows = lambda *r: spark.createDataFrame(list(r), "k long, v string")
    assert table.read() is None
    assert table.commit(rows((1, "a"))) == 0
    assert table.upsert(rows((1, "b"), (2, "c")), ["k"]) == 1
    assert values(table.read(), "k", "v") == [(1, "b"), (2, "c")]
    table.commit(rows((9, "z")), 1)  # run again: nothing changes
    assert values(table.read(), "k", "v") == [(1, "b"), (2, "c")]
    assert values(table.read(0), "k", "v") == [(1, "a")]
    table.compact()
    assert table.versions() == [1]


def test_commit_images(spark):
    images_ = spark.createDataFrame([("m1", 0)], "md5 string, row_index long")
    sources = spark.createDataFrame([("a", 1, "m1", "old")], "site string, post_id long, md5 string, rating string")
    counts = spark.createDataFrame([("t", 1)], "tag string, positives long")
    new = spark.createDataFrame([("m2", 1)], "md5 string, row_index long")
    more = spark.createDataFrame([("a", 1, "m2", "new"), ("b", 2, "m2", "x")], "site string, post_id long, md5 string, rating string")
    tags = spark.createDataFrame([("m2", "t"), ("m2", "t"), ("m2", "unknown")], "md5 string, tag string")
    i, s, c = store.commit_images(images_, sources, counts, new, more, tags)
    assert values(s, "site", "post_id", "md5", "rating") == [("a", 1, "m1", "new"), ("b", 2, "m2", "x")]
    assert values(c, "tag", "positives") == [("t", 2)] and i.count() == 2
    with pytest.raises(ValueError):
        store.commit_images(i, s, c, new, more, tags)


def test_cache_violations(spark):
    df = spark.createDataFrame([(0,), (1,), (1,), (7,)], "row_index long")
    assert values(store.cache_violations(df, 5), "row_index", "problem") == [(1, "duplicate"), (7, "out of bounds")]


# --- vectors and grids ----------------------------------------------------------------------------------------------


def test_scores(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "item long, v array<double>")
    tags = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0])], "label int, v array<double>")
    got = dict(values(scoring.score(items, tags, None), "label", "conf"))
    assert got[0] > 0.5 and got[1] == 0.5
    with pytest.raises(Exception, match="differ in size"):
        scoring.score(spark.createDataFrame([(1, [1.0])], "item long, v array<double>"), tags, None).collect()


def test_scores_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    items = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(20)], "item long, v array<double>")
    tags = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(7)], "label int, v array<double>")
    whole = values(scoring.score(items, tags, 0.5), "item", "label", "conf")
    monkeypatch.setattr(scoring, "BLOCK_VALUES", 8)
    assert np.allclose(values(scoring.score(items, tags, 0.5), "item", "label", "conf"), whole)


@pytest.mark.parametrize("w, h, canvas, want", [(16, 8, 8, (0, 2, 8, 4)), (8, 8, 4, (0, 0, 4, 4))])
def test_letterbox(spark, w, h, canvas, want):
    box = spark.range(1).select(spatial.letterbox(F.lit(w), F.lit(h), canvas).alias("b")).first()["b"]
    assert tuple(box) == want == images.letterbox_box(w, h, canvas)


@pytest.mark.parametrize("box, canvas, n, want", [((0, 1, 4, 2), 4, 4, 8), ((0, 15, 32, 1), 32, 2, 1), ((0, 0, 4, 4), 4, 4, 16)])
def test_valid_cells(spark, box, canvas, n, want):
    col = F.struct(*[F.lit(v).alias(c) for c, v in zip(("x", "y", "width", "height"), box)])
    cells = spark.range(1).select(spatial.valid_cells(col, canvas, n, n).alias("c")).first()["c"]
    mask = images.valid_mask(box, canvas, n, n)
    assert len(cells) == want and sorted((c["y"], c["x"]) for c in cells) == sorted(zip(*(k.tolist() for k in np.nonzero(mask))))


def test_components_agree_with_propagation(spark):
    rng = np.random.default_rng(4)
    grids = rng.random((6, 8, 8))
    df = spark.createDataFrame([(i, g.reshape(-1).tolist()) for i, g in enumerate(grids)], "item long, values array<double>")
    found = spatial.components(df, 8, 8, 0.5, 0.0).groupBy("item").count()
    cells = [(i, int(y), int(x)) for i, g in enumerate(grids) for y, x in zip(*np.nonzero(g >= 0.5))]
    told = spatial.propagate(spark.createDataFrame(cells, "item long, y int, x int")).groupBy("item").agg(F.count_distinct("component").alias("count"))
    assert values(found, "item", "count") == values(told, "item", "count")


def test_tighter_percentile_covers_less(spark):
    df = spark.createDataFrame([(0, np.linspace(0.4, 0.9, 16).tolist())], "item long, values array<double>")
    loose, tight = (spatial.components(df, 4, 4, 0.5, p).agg(F.sum("cells")).first()[0] for p in (0.1, 0.9))
    assert tight < loose
    assert spatial.components(df, 4, 4, 0.95, 0.0).count() == 0


def test_localised_loss_tends_to_the_mean(spark):
    df = spark.createDataFrame([([0.1, 0.9, -0.4, 0.2], 1)], "cells array<double>, y int")
    mean = float(np.log1p(np.exp(-0.2)))
    assert losses.localized(df, 1000.0).first()["loss"] == pytest.approx(mean, abs=1e-3)
    assert losses.localized(df, 0.1).first()["loss"] < losses.localized(df, 1000.0).first()["loss"]


def test_fit_tag_lowers_the_loss(spark):
    rng = np.random.default_rng(0)
    rows = [((rng.normal(size=3) + s * np.array([1, 0, 0])).tolist(), s) for s in (1, -1) for _ in range(30)]
    row, seen = training.fit_tag(spark.createDataFrame(rows, "v array<double>, y int").coalesce(1), steps=12)
    assert seen[-1] < seen[0] and row[0] > 0


def test_softplus_and_lse(spark):
    r = spark.range(1).select(vectors.softplus(F.lit(800.0)), vectors.softplus(F.lit(-800.0)), vectors.log_sum_exp(F.array(F.lit(1000.0), F.lit(1000.0)))).first()
    assert r[0] == 800.0 and r[1] == 0.0 and r[2] == pytest.approx(1000 + np.log(2))


# --- images ---------------------------------------------------------------------------------------------------------


def test_pixels_round_trip():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (10, 20, 3)).astype(np.uint8)
    content, box = images.encode_content(image, 16)
    full = images.reconstruct(content, box, 16)
    assert images.strip(full, box) == content
    assert (full[:, : box[1]] == 0).all()
    with pytest.raises(ValueError):
        images.reconstruct(content[:-1], box, 16)


def structured(seed, size=160):
    """A picture: a sky that fades, hills, a few shapes."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:size, 0:size] / size
    out = np.stack([90 + 120 * y, 120 + 60 * (1 - y), 200 - 90 * y], axis=2)
    for _ in range(9):
        cx, cy, r = rng.uniform(0.1, 0.9, 2).tolist() + [rng.uniform(0.06, 0.3)]
        inside = (np.abs(x - cx) < r) & (np.abs(y - cy) < r * rng.uniform(0.4, 1)) if rng.random() < 0.5 else (x - cx) ** 2 + (y - cy) ** 2 < r * r
        out[inside] = rng.uniform(0, 255, 3)
    return out


def recompressed(image, step=12):
    """Every 8x8 block's coefficients rounded to multiples of ``step``."""
    d = images.dct(8) * np.sqrt(2 / 8)
    d[0] /= np.sqrt(2)
    n = image.shape[0] // 8
    blocks = image.reshape(n, 8, n, 8, 3)
    coded = np.round(np.einsum("ui,aibjc,vj->aubvc", d, blocks, d) / step) * step
    return np.clip(np.round(np.einsum("ui,aubvc,vj->aibjc", d, coded, d).reshape(image.shape)), 0, 255)


def test_hash_is_stable_under_recompression():
    distance = lambda a, b: ((images.perceptual_hash(a) ^ images.perceptual_hash(b)) & (1 << 64) - 1).bit_count()
    pictures = [structured(k) for k in range(6)]
    for k, image in enumerate(pictures):
        assert distance(image, recompressed(image)) <= 2
        assert distance(image, pictures[k - 1]) >= 8


def test_dct_matches_its_definition():
    x = np.random.default_rng(2).random(8)
    want = [sum(x[k] * np.cos(np.pi / 8 * (k + 0.5) * u) for k in range(8)) for u in range(8)]
    assert np.allclose(images.dct(8) @ x, want)


def plain_hash(plane):
    """The reference's loops over a 32 x 32 plane: each sum term by term."""
    cosine = [[math.cos(math.pi / 32 * (x + 0.5) * u) for x in range(32)] for u in range(8)]

    def total(terms):
        out = 0.0
        for x in terms:  # ``sum`` makes up for lost digits
            out += x
        return out

    across = [[total(row[x] * cosine[u][x] for x in range(32)) for u in range(8)] for row in plane.tolist()]
    low = [total(across[y][u] * cosine[t][y] for y in range(32)) for t in range(8) for u in range(8)]
    middle = total(sorted(low)[31:33]) / 2
    return int("".join("01"[v > middle] for v in low), 2)


def test_hash_of_equal_middle_frequencies_adds_in_order():
    """Frequencies (6, 2) and (2, 6) of this picture are equal and lie in the middle, so their bits hang on the last digit."""
    picture = np.array([[100, 155, 108, 151, 120, 96, 188, 90], [127, 111, 86, 168, 133, 131, 19, 86], [87, 103, 139, 138, 145, 145, 148, 112], [138, 96, 147, 92, 129, 102, 146, 183], [97, 152, 51, 132, 149, 108, 101, 130], [90, 106, 103, 171, 176, 106, 164, 104], [134, 143, 105, 185, 143, 116, 118, 126], [134, 115, 130, 134, 96, 115, 159, 188]], np.uint8)
    large = images.resize(picture.astype(np.float64), 32, 32)
    rng = np.random.default_rng(3)
    for grey, image in [(large, picture), *((x.astype(np.float64), x) for x in rng.integers(0, 256, (20, 32, 32)))]:
        weighed = grey * 0.299 + grey * 0.587 + grey * 0.114
        assert images.perceptual_hash(np.repeat(image[..., None], 3, axis=2)) % 2**64 == plain_hash(weighed)


def test_refine_keeps_a_flat_map_and_follows_edges():
    guide = np.zeros((16, 16, 3))
    guide[:, 8:] = 1
    assert np.allclose(images.refine(np.full((4, 4), 0.3), guide), 0.3)
    heat = np.zeros((4, 4))
    heat[:, :2] = 1
    out = images.refine(heat, guide)
    assert out[8, 6] - out[8, 9] > images.resize(heat, 16, 16)[8, 6] - images.resize(heat, 16, 16)[8, 9]


def test_crop_keeps_the_shape():
    rng = np.random.default_rng(0)
    out = images.crop_flip(np.ones((3, 10, 12)), rng)
    assert out.shape == (3, 10, 12) and 0 < out.sum() <= 360


# --- text and sources -----------------------------------------------------------------------------------------------


def test_text_functions(spark):
    df = spark.createDataFrame([("1girl  solo &amp;_(x) ", "general", "Fri Jan 01 00:00:00 +0000 2021", "a%20b+c")], "t string, r string, d string, u string")
    r = df.select(text.tag_list(text.html_unescape("t")).alias("t"), text.rating_letter(F.col("r")).alias("r"), text.asctime(F.col("d")).cast("string").alias("d"), text.url_unescape(F.col("u")).alias("u"), text.asctime(F.lit("junk")).alias("j")).first()
    assert r["t"] == ["1girl", "solo", "&_(x)"] and r["r"] == "g" and r["d"] == "2021-01-01 00:00:00" and r["u"] == "a b+c" and r["j"] is None


def test_alias_page(spark):
    row = '<tr><td><a href="index.php?page=post&amp;tags={a}">x</a> <span class="tag-count">1</span> <b>&rarr;</b> <a href="i?tags={b}">y</a> <span class="tag-count">2</span></td></tr>'
    page = row.replace("{a}", "curvy_figure").replace("{b}", "curvy") + row.replace("{a}", "o%27x").replace("{b}", "n")
    got = spark.createDataFrame([(page,)], "p string").select(F.inline(text.alias_pairs(F.col("p")))).collect()
    assert [tuple(r) for r in got] == [("curvy_figure", "curvy"), ("o%27x", "n")]
