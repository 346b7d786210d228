"""Readers, packed files, paging, retries, ingestion."""

import json
import struct

import numpy as np
import pytest

from tessera.operators import images
from tessera.plans import commands
from tessera.sources import files, paged, state
from tessera.streaming import ingest


def test_manifest_round_trip(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps([{"imagePath": "images/a.png", "tags": ["solo", "1girl"]}, {"imagePath": "images/b.png", "tags": ["nurse"]}]))
    df = files.manifest(spark, str(path))
    files.write_manifest(df, str(tmp_path / "out"))
    again = spark.read.json(str(tmp_path / "out"))
    assert sorted((r["image_path"], tuple(r["tags"])) for r in again.collect()) == [("images/a.png", ("solo", "1girl")), ("images/b.png", ("nurse",))]


def test_rules_without_a_file(spark, tmp_path):
    assert not files.exclusion_rules(spark, str(tmp_path / "none")).excludes
    (tmp_path / "r").write_text("# c\nx\n!meta:y\n")
    rules = files.exclusion_rules(spark, str(tmp_path / "r"))
    assert rules.excludes == {"x"} and rules.includes == {"meta:y"}


def test_alias_table(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"head_pat": "headpat", "x": "y"}')
    assert sorted(map(tuple, files.alias_table(spark, str(tmp_path / "a.json")).collect())) == [("head_pat", "headpat"), ("x", "y")]


def test_posts_without_a_digest_are_dropped(spark, tmp_path):
    rows = [{"id": 3, "md5": "m", "file_url": "u", "tag_string": "a  b", "rating": "s", "created_at": "2021-01-01T00:00:00Z"}, {"id": 2, "md5": None, "file_url": "u"}]
    (tmp_path / "p.json").write_text(json.dumps(rows))
    got = files.first_site_posts(spark, str(tmp_path / "p.json")).collect()
    assert [(r["post_id"], r["tags"], r["rating"]) for r in got] == [(3, ["a", "b"], "s")]
    raw = spark.createDataFrame([(3,), (2,)], "id long")
    assert files.next_cursor(raw, 2) == 2 and files.next_cursor(raw, 3) is None


def test_second_site_decodes(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"post": [{"id": 1, "md5": "m", "file_url": "u", "tags": "1girl &amp;x", "rating": "general", "created_at": "Fri Jan 01 00:00:00 +0000 2021", "width": 1, "height": 2}, {"id": 2, "md5": "n", "file_url": ""}]}))
    got = files.second_site_posts(spark, str(tmp_path / "p.json")).collect()
    assert [(r["tags"], r["rating"], r["created_at"].year) for r in got] == [(["1girl", "&x"], "g", 2021)]


def test_packed_cache(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(0, 1, 4, 2, rng.integers(0, 256, 24).astype(np.uint8).tobytes()), (0, 0, 2, 2, bytes(12))]
    data = files.pack_cache(rows, 4)
    (tmp_path / "images.bin").write_bytes(data)
    got = files.image_cache(spark, str(tmp_path / "images.bin")).orderBy("row_index").collect()
    assert [(r["x"], r["y"], r["width"], r["height"], bytes(r["pixels"])) for r in got] == rows
    old = b"LBX1" + struct.pack("<ii", 1, 4) + struct.pack("<4i", *rows[0][:4]) + images.reconstruct(rows[0][4], rows[0][:4], 4).astype("<f4").tobytes()
    assert list(files.parse_cache(old))[0][5] == rows[0][4]
    with pytest.raises(ValueError):
        list(files.parse_cache(data[:-1]))
    with pytest.raises(ValueError):
        list(files.parse_cache(b"nope" + data[4:]))


def test_embedding_table(spark, tmp_path):
    (tmp_path / "e.bin").write_bytes(struct.pack("<ii", 3, 2) + np.arange(1, 7, dtype="<f4").tobytes())
    got = files.embedding_table(spark, str(tmp_path / "e.bin")).orderBy("row_index").collect()
    assert [list(r["v"]) for r in got] == [[1, 2, 3], [4, 5, 6]]


def test_corpus_joins(spark):
    blobs = spark.createDataFrame([(1, 10, b"x"), (1, 9, b"y"), (2, 1, b"z")], "image_id long, blob_id long, data binary")
    links = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b")], "image_id long, name string")
    got = files.corpus(blobs, links).orderBy("image_id").collect()
    assert [(bytes(r["data"]), r["tags"]) for r in got] == [(b"y", ["a", "b"]), (b"z", [])]


def test_image_files(spark, tmp_path):
    for name in ("b.PNG", "a.jpg", "note.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r["path"].rsplit("/", 1)[1] for r in files.image_files(spark, str(tmp_path)).collect()] == ["a.jpg", "b.PNG"]


def pages(folder, sizes):
    n = 0
    for k, size in enumerate(sizes):
        (folder / f"{k}.json").write_text(json.dumps([{"id": n + i, "name": f"t{n + i}"} for i in range(size)]))
        n += size


def test_paged_batch_ends_at_an_empty_page(spark, tmp_path):
    pages(tmp_path, [3, 3, 0, 2])
    spark.dataSource.register(paged.PagedSource)
    got = spark.read.format("tessera_pages").load(str(tmp_path))
    assert sorted(r["id"] for r in got.collect()) == list(range(6))


def test_cursor_reader_walks_once(tmp_path):
    pages(tmp_path, [4, 3])
    reader = paged.CursorReader(["id", "name"], {"path": str(tmp_path), "pageSize": "3"})
    at, seen = reader.initialOffset(), []
    while True:
        rows, to = reader.read(at)
        rows = list(rows)
        if not rows:
            break
        assert list(reader.readBetweenOffsets(at, to)) == rows
        seen += [r[0] for r in rows]
        at = to
    assert seen == list(range(7))


def test_patience():
    waits, answers = [], [paged.Refused(429), paged.Refused(429, 7.0), ConnectionError(), "ok"]

    def ask():
        x = answers.pop(0)
        if isinstance(x, Exception):
            raise x
        return x

    assert paged.patiently(ask, waits.append) == "ok" and waits == [5.0, 7.0, 20.0]
    answers[:] = [paged.Refused(404)]
    assert paged.patiently(ask, waits.append) is None
    answers[:] = [paged.Refused(500)]
    with pytest.raises(paged.Refused):
        paged.patiently(ask, waits.append)


def test_pace():
    now, waits = [0.0], []
    pace = paged.Pace(4.0, clock=lambda: now[0], sleep=waits.append)
    for _ in range(3):
        pace.wait()
    assert waits == [0.25, 0.5]


def test_sites():
    assert ingest.available_sites(["a", "b"], {"a"}) == ["b"]
    with pytest.raises(RuntimeError):
        ingest.available_sites(["a"], {"a"})


def test_ingest_is_idempotent(spark, tmp_path):
    work = ingest.Ingest(spark, str(tmp_path / "t"))
    first = spark.createDataFrame([(1, "a", 10, 0b1111, ["x"]), (2, "b", 10, 0b1111, ["y"]), (3, "a", 11, 0b1101, ["z"])], "seq long, site string, item long, h long, tags array<string>")
    work.apply(first, 0)
    work.apply(first, 0)
    second = spark.createDataFrame([(4, "a", 12, 1 << 40, ["w"]), (5, "a", 10, 0b1111, ["v"])], "seq long, site string, item long, h long, tags array<string>")
    work.apply(second, 1)
    images_ = {r["item"]: r["leader"] for r in work.images.read().collect()}
    assert images_ == {10: 10, 11: 10, 12: 12}
    tags = sorted((r["item"], r["tag"]) for r in work.tags().collect())
    assert tags == [(10, "v"), (10, "x"), (10, "y"), (10, "z"), (12, "w")]
    assert {r["site"]: (r["last"], r["n"]) for r in work.cursor.read().collect()} == {"a": (5, 4), "b": (2, 1)}


def test_ingest_in_batches_is_as_in_one(spark, tmp_path):
    """Leaders over eight batches, of which one is run again, against all arrivals in one; every part holds new images only."""
    import random

    from tessera.operators.dedup import leaders

    rng = random.Random(3)
    bases = [rng.getrandbits(63) for _ in range(12)]
    rows = []
    for seq in range(160):
        h = rng.choice(bases)
        for _ in range(rng.randrange(4)):
            h ^= 1 << rng.randrange(63)
        rows.append((seq, "ab"[seq % 2], 1000 + (seq if rng.random() < 0.8 or not seq else rng.randrange(seq)), h, [f"t{rng.randrange(5)}"]))
    first = {}
    for r in rows:  # an item that comes again has its first hash
        first.setdefault(r[2], r[3])
    rows = [(*r[:3], first[r[2]], r[4]) for r in rows]
    schema = "seq long, site string, item long, h long, tags array<string>"
    work = ingest.Ingest(spark, str(tmp_path / "t"))
    for k in range(8):
        part = spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema)
        work.apply(part, k)
        if k == 3:
            work.apply(part, k)
    arrivals = {}
    for r in rows:
        arrivals.setdefault(r[2], (r[0], r[3]))
    table = spark.createDataFrame([(seq, h) for seq, h in arrivals.values()], "item long, h long")
    by_seq = {seq: item for item, (seq, _) in arrivals.items()}
    want = {by_seq[r["item"]]: by_seq[r["leader"]] for r in leaders(table, 2).collect()}
    assert {r["item"]: r["leader"] for r in work.images.read().collect()} == want
    assert work.images.read().count() == len(arrivals)
    assert {(r["item"], r["tag"]) for r in work.tags().collect()} == {(want[r[2]], t) for r in rows for t in r[4]}
    work.images.compact()
    assert len(work.images.versions()) == 1 and {r["item"]: r["leader"] for r in work.images.read().collect()} == want


def plain_crawl(posts, most, negatives, page_size):
    """The rounds of a crawl in plain Python; hashes are all far apart."""
    floor = -(-most // len({p["site"] for p in posts}))
    lists = {}
    for p in sorted(posts, key=lambda p: -p["post_id"]):
        lists.setdefault((p["tag"], p["site"], p["phase"]), []).append(p)
    at, seen, done, images = {k: 0 for k in lists}, {k: 0 for k in lists}, set(), {}
    while True:
        count = lambda t: sum(t in tags for tags in images.values())
        wants = lambda k: k not in done and (seen[k] < floor or count(k[0]) < most if k[2] == "positive" else negatives - (len(images) - count(k[0])) > 0)
        now = [k for k in lists if k[2] == "positive" and wants(k)]
        now += [k for k in lists if k[2] != "positive" and wants(k) and not any(x[1] == k[1] for x in now if x[2] == "positive")]
        if not now:
            return images, seen
        for k in now:
            page = lists[k][at[k] : at[k] + page_size]
            at[k] += len(page)
            seen[k] += len(page)
            if len(page) < page_size:
                done.add(k)
            for p in page:
                images.setdefault(p["item"], set()).update(p["tags"])


@pytest.mark.parametrize("most, negatives", [(4, 6), (100, 0), (3, 50)])
def test_crawl_of_two_sites(spark, tmp_path, most, negatives):
    import random

    from tessera.streaming.crawl import crawl

    rng = random.Random(most)
    posts = []
    for site in "ab":
        for post in range(40):
            item = 100 + post if rng.random() < 0.5 else 1000 * ord(site) + post
            tags = sorted({rng.choice("xyz") for _ in range(2)})
            posts += [{"tag": t, "site": site, "phase": "positive", "post_id": post, "item": item, "h": hash((item, 7)) * 2654435761 % (1 << 62), "tags": tags} for t in tags]
            posts += [{"tag": t, "site": site, "phase": "negative", "post_id": post, "item": item, "h": hash((item, 7)) * 2654435761 % (1 << 62), "tags": tags} for t in set("xyz") - set(tags)]
    schema = "tag string, site string, phase string, post_id long, item long, h long, tags array<string>"
    df = spark.createDataFrame(posts, schema)
    work, cursors = ingest.Ingest(spark, str(tmp_path / "w"), 0), ingest.Cursors(spark, str(tmp_path / "c"))
    rounds = crawl(df, work, cursors, most, negatives, 9)
    images, seen = plain_crawl(posts, most, negatives, 9)
    got = {}
    for r in work.tags().collect():
        got.setdefault(r["item"], set()).add(r["tag"])
    assert got == images
    assert {(r["tag"], r["site"], r["phase"]): r["seen"] for r in cursors.state().collect()} == {k: n for k, n in seen.items() if n}
    assert crawl(df, work, cursors, most, negatives, 9) == rounds  # nothing is left to do


def test_refresh_walk(spark):
    sources = spark.createDataFrame([("a", 1), ("a", 5), ("a", 3), ("b", 2)], "site string, post_id long")
    got = [([r["post_id"] for r in rows], after) for rows, after in ingest.refresh_walk(sources, "a", 2)]
    assert got == [([1, 3], 3), ([5], 5)]


def test_options_keep_no_secret(tmp_path):
    path = str(tmp_path / "o.json")
    assert state.load_options(path) is None
    state.save_options(path, {"min_images": 5, "api_key": "x", "Password": "y"})
    assert state.load_options(path) == {"min_images": 5}
    saved = state.TrainingState(2, 0.5, 1, [0.7, 0.5])
    saved.save(path)
    assert state.TrainingState.load(path) == saved


def test_error_log(spark, tmp_path):
    path = str(tmp_path / "log")
    for m in ("one", "two"):
        state.log_errors(spark.createDataFrame([("a", m)], "site string, message string"), path)
    assert sorted(r["line"][20:] for r in state.read_log(spark, path).collect()) == ["[a] one", "[a] two"]


def test_survey_command(spark):
    listing = spark.createDataFrame([("a", "x", "general", 900, 0), ("a", "old", "general", 600, 1), ("a", "y", "general", 100, 2), ("b", "x", "character", 700, 0)], "site string, raw string, category string, n long, pos long")
    aliases = spark.createDataFrame([("old", "new")], "antecedent string, consequent string")
    stored = spark.createDataFrame([("old", 1, 1, 5), ("kept", 2, 2, 6)], "name string, count_a long, count_b long, positives long")
    tags, said = commands.survey_tags(listing, aliases, stored)
    assert sorted((r["name"], r["count_a"], r["count_b"], r["positives"]) for r in tags.collect()) == [("kept", 2, 2, 6), ("new", 600, None, 0), ("x", 900, 700, 0)]
    assert said.first()["eligible_tags"] == 2


def test_large_cache_command(spark):
    links = spark.createDataFrame([(i, "common") for i in range(20)] + [(3, "rare"), (4, "mid"), (5, "mid")], "image_id long, name string")
    blobs = spark.createDataFrame([(i, i, b"x") for i in range(20)], "image_id long, blob_id long, data binary")
    images_, vocab = commands.build_large_cache(blobs, links, 10, 2, 2)
    assert images_.count() == 10 and {4, 5} <= {r["item"] for r in images_.collect()}
    assert {r["tag"] for r in vocab.collect()} == {"common", "mid"}


def test_large_cache_keeps_untagged_images(spark):
    links = spark.createDataFrame([(i, "common") for i in range(5)] + [(5, "rare")], "image_id long, name string")
    blobs = spark.createDataFrame([(i, i, b"x") for i in range(8)], "image_id long, blob_id long, data binary")
    for most in (None, 7):
        got = {r["item"]: r["tags"] for r in commands.build_large_cache(blobs, links, most, 2, 2)[0].collect()}
        assert len(got) == (most or 8) and got[5] == [] and got[6] == [] and got[0] == ["common"]


def test_detect_command(spark):
    scores = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.7), (1, "c", 0.1)], "item long, label string, conf double")
    grid = [0.1, 0.9, 0.1, 0.1]
    grids = spark.createDataFrame([(1, t, grid, 100, 100) for t in "abc"], "item long, label string, values array<double>, image_width int, image_height int")
    got = json.loads(commands.detect(scores, grids, 2, 2).first()["json"])
    assert [x["tag"] for x in got] == ["a", "b"] and got[0]["boxes"] == [{"x": 50, "y": 0, "width": 50, "height": 50, "confidence": 0.9}]
