"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF
shingles, banded, verified by weighted Jaccard similarity.

1. Texts that are equal to the byte become one node, the MD5 of the text.
2. Document frequencies of 5-word shingles are summed in a count-min row of
   ``2**SKETCH_BITS`` counters: 4 MB however large the corpus. A shingle's
   weight is its count in the text times ``1 + IDF_SPREAD * idf / idf_max``.
   The spread is small on purpose: in a family of thousands of near copies the
   shared shingles are frequent and the edited ones rare, and a full-range idf
   would take such copies apart.
3. Each text gets ``BANDS * ROWS`` consistent samples; texts whose samples agree
   in a band share a bucket.
4. A bucket is linked as a star around its least node, never as all pairs.
   Links whose samples agree often are verified on whole texts and give the
   first components; what is left out here is looked at in the next step.
5. Buckets that still hold more than one component are searched in full: their
   nodes' weighted shingle sets meet in one task, which works out every
   similarity between nodes of different components and gives only the links
   that join components, fewer than there are nodes. A large bucket is cut into
   blocks, every pair of which is a group of its own; its largest component is
   not held against itself, and a pair is looked at in the first band that it
   shares alone. No bucket is capped, no pair becomes a row, and of texts that
   share a band none is left out.
6. Components come from hooking and pointer jumping in Spark, with every round
   written to the shared checkpoint folder.

Defined results: null text equals empty text; texts without a word are alike
only if they are equal. Repeated rows are copies of each other. Null ids take
part; a class whose ids are all null has a null class id. An empty table gives
no rows. Ties for the representative go to the least id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import cut, distinct_shingles, mix, shingles, steps, word_hashes

THRESHOLD = 0.8
SHINGLE_WORDS = 5
BANDS, ROWS = 12, 4
SKETCH_BITS = 20
SKETCH_PARTS = 16
IDF_SPREAD = 0.1
#: Equal samples for a link of a star to be verified at once; of 48, texts that are just 0.8 alike have fewer in 1 of 250 cases.
LEAST_AGREEING = 31
#: Nodes, and shingles, of a block of a large bucket; two blocks are held against each other at once.
BLOCK, BLOCK_SHINGLES = 256, 1 << 17
#: Links whose components one task works out in memory (some 100 MB); more are worked out by joins.
LINKS_AT_ONCE = 500_000
#: Rows of a name and some numbers (100 bytes at most) that are sent to the tasks; more are joined by a shuffle.
BROADCAST_NAMES = 100_000
#: Text bytes of a step of signing: its 48 draws hold some 100 bytes for each word.
SIGN_BYTES = 1 << 18

_RNG = np.random.Generator(np.random.PCG64(404))
_KEYS = _RNG.integers(1, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) | np.uint64(1)


def _gamma_table() -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of 2**16 equal steps, by Newton's method on 1 - (1 + x) exp(-x)."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.sqrt(2 * u) + u
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-12), 1e-6)
    return x


_GAMMA = _gamma_table()
_R = _GAMMA.astype(np.float32)
_R_INVERSE = (1 / _GAMMA).astype(np.float32)
_LOG_C = np.log(_GAMMA).astype(np.float32)


def samples(keys: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``BANDS * ROWS`` consistent weighted samples (32 bits each) of every set of weighted elements.

    For an element with weight S: r, c ~ Gamma(2, 1), b ~ U(0, 1), t = floor(ln S / r + b), ln y = r (t - b), and the
    element with the least ln c - ln y - r is the sample, together with its t. All draws are functions of the element.
    """
    sets = len(at) - 1
    out = np.zeros((sets, len(_KEYS)), np.uint32)
    full = np.flatnonzero(np.diff(at))
    if not len(full):
        return out
    log_w = np.log(weights).astype(np.float32)
    starts = at[:-1][full]
    for k, (factor, shift) in enumerate(_KEYS):
        with np.errstate(over="ignore"):
            z = (keys + shift) * factor
            z ^= z >> np.uint64(29)
            z *= np.uint64(0xBF58476D1CE4E5B9)
            z ^= z >> np.uint64(32)
        i = (z & np.uint64(0xFFFF)).astype(np.intp)
        r = _R[i]
        b = (z >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
        t = np.floor(log_w * _R_INVERSE[i] + b)
        a = _LOG_C[((z >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.intp)] - r * (t - b + 1)
        bits = a.view(np.uint32)
        bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)
        with np.errstate(over="ignore"):
            name = ((z ^ (t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * factor) >> np.uint64(32)
        out[full, k] = (np.minimum.reduceat((bits << np.uint64(32)) | name, starts) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.intp)


def _shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return distinct_shingles(*shingles(*word_hashes(texts), SHINGLE_WORDS))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's document frequencies: the counters in parts, as (places, counts) of those that are not 0."""
    table = np.zeros(1 << SKETCH_BITS, np.uint32)
    for whole in batches:
        for batch in steps(whole):
            keys, _, _ = _shingle_sets(batch.column(0))
            places, count = np.unique(_bucket(keys), return_counts=True)
            table[places] += count.astype(np.uint32)
    width = len(table) // SKETCH_PARTS
    for part in range(SKETCH_PARTS):
        own = table[part * width : (part + 1) * width]
        place = np.flatnonzero(own).astype("<u2")
        count = own[place].astype("<u4")
        small = bool(len(count) == 0 or count.max() < 256)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([place.tobytes()], pa.binary()), pa.array([(count.astype("u1") if small else count).tobytes()], pa.binary()), pa.array([small])], names=["part", "places", "counts", "small"])


def _sum_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, place, count, small in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = sums.setdefault(part, np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.int64))
            own[np.frombuffer(place, "<u2")] += np.frombuffer(count, "u1" if small else "<u4")
    for part, own in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([own.astype("<i8").tobytes()], pa.binary())], names=["part", "counts"])


def idf_table(texts: DataFrame) -> np.ndarray:
    """Weight factor of a shingle by its counter, for all documents' ``text`` column: 2**SKETCH_BITS floats."""
    summed = texts.select("text").mapInArrow(_sketch, "part int, places binary, counts binary, small boolean").repartition(SKETCH_PARTS, "part").mapInArrow(_sum_sketches, "part int, counts binary")
    df = np.zeros((SKETCH_PARTS, (1 << SKETCH_BITS) // SKETCH_PARTS))
    for row in summed.collect():  # SKETCH_PARTS rows of fixed size
        df[row["part"]] += np.frombuffer(row["counts"], "<i8")
    count = max(1, texts.count())
    idf = np.log1p(count / np.maximum(df.reshape(-1), 1))
    return (1 + IDF_SPREAD * idf / idf.max()).astype(np.float32)


def _signer(factors):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = factors.value
        for whole in batches:
            for batch in steps(whole, limit=SIGN_BYTES):
                keys, counts, at = _shingle_sets(batch.column(2))
                found = samples(keys, counts * table[_bucket(keys)], at)
                bands = np.zeros((len(found), BANDS), np.uint64)
                with np.errstate(over="ignore"):
                    for j in range(ROWS):
                        bands = mix(bands + found[:, j::ROWS].astype(np.uint64) * _KEYS[j, 0])
                    bands = mix(bands + np.arange(BANDS, dtype=np.uint64) * _KEYS[ROWS, 0])
                some = np.diff(at) > 0
                bands = pa.array([b if ok else None for b, ok in zip(bands.view(np.int64), some, strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bands, pa.array([x.tobytes() for x in found.astype(np.uint8)], pa.binary()), pa.array(np.diff(at))], names=["doc_id", "node", "bands", "samples", "size"])

    return signed


def _sample_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of (a, b, samples of a, samples of b) that agree often enough."""
    for batch in batches:
        kept = pa.array((_sample_matrix(batch.column(2)) == _sample_matrix(batch.column(3))).sum(axis=1) >= LEAST_AGREEING)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(kept)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, set) of (node, text): 6 bytes for each distinct shingle and then 4 for each count."""
    for whole in batches:
        for batch in steps(whole):
            keys, counts, at = _shingle_sets(batch.column(1))
            keys, counts = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6], counts.astype("<u4")
            sets = [keys[i:k].tobytes() + counts[i:k].tobytes() for i, k in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "set"])


def _unpack(sets: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles and counts of all ``sets``, and where each set begins; the last entry is the end."""
    sizes = np.array([len(x) // 10 for x in sets], np.int64)
    keys = np.zeros((int(sizes.sum()), 8), np.uint8)
    keys[:, :6] = np.frombuffer(b"".join(x[: 6 * n] for x, n in zip(sets, sizes.tolist(), strict=True)), np.uint8).reshape(-1, 6)
    counts = np.frombuffer(b"".join(x[6 * n :] for x, n in zip(sets, sizes.tolist(), strict=True)), "<u4")
    return keys.view("<u8").reshape(-1), counts, np.concatenate([[0], np.cumsum(sizes)])


def joining(band: int, sides: np.ndarray, probe: np.ndarray, parts: np.ndarray, bands: np.ndarray, keys: np.ndarray, weights: np.ndarray, at: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """Links (i, k, similarity) that join the components ``parts`` of a group's nodes as far as similarities of ``threshold`` do.

    Each ``probe`` is held against all nodes of other components (where there are two sides: of the other side) that do not
    share the bucket of a lower band.
    """
    parts = parts.copy()
    codes = np.unique(keys, return_inverse=True)[1]
    own = np.zeros(int(codes.max(initial=-1)) + 1)  # the probe's weights
    sizes = np.diff(at)
    totals = np.concatenate([[0.0], np.cumsum(weights)])
    totals = totals[at[1:]] - totals[at[:-1]]
    two = sides.min() != sides.max()
    lower = bands[:, :band]
    out = []
    for i in np.flatnonzero(probe).tolist():
        other = np.flatnonzero((parts != parts[i]) & (sides != sides[i]) if two else parts != parts[i])
        other = other[~(lower[other] == lower[i]).any(axis=1)]
        if not len(other):
            continue
        mine = slice(at[i], at[i + 1])
        own[codes[mine]] = weights[mine]
        n = sizes[other]
        begin = np.cumsum(n) - n
        place = np.arange(n.sum()) + np.repeat(at[other] - begin, n)
        low = np.add.reduceat(np.minimum(own[codes[place]], weights[place]), begin)
        own[codes[mine]] = 0
        alike = low / (totals[i] + totals[other] - low)
        for k, similarity in zip(other.tolist(), alike.tolist(), strict=True):
            if similarity >= threshold and parts[k] != parts[i]:
                parts[parts == parts[k]] = parts[i]
                out.append((i, k, similarity))
    return out


def _joiner(factors, threshold: float):
    """Links (a, b, similarity), a < b, of rows (group, band, side, probe, node, component, bands, set) in order of group."""

    def links(rows: list[tuple]) -> list[tuple[bytes, bytes, float]]:
        names: dict[bytes, int] = {}
        parts = np.array([names.setdefault(r[5], len(names)) for r in rows])
        if len(names) < 2:
            return []
        keys, counts, at = _unpack([r[7] for r in rows])
        sides, probe = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        found = joining(rows[0][1], sides, probe, parts, np.array([r[6] for r in rows], np.int64), keys, counts * factors.value[_bucket(keys)], at, threshold)
        return [(min(rows[i][4], rows[k][4]), max(rows[i][4], rows[k][4]), x) for i, k, x in found]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        found: list[tuple[bytes, bytes, float]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    found += links(held)
                    held = []
                held.append(row)
        found += links(held) if held else []
        kinds = [pa.binary(), pa.binary(), pa.float64()]
        for at in range(0, len(found), 10_000):  # fewer than the nodes of this task
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found[at : at + 10_000], strict=True), kinds, strict=True)], names=["a", "b", "similarity"])

    return joined


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of lesser weights over sum of greater ones; (ascending keys, weights) each."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    total = a[1].sum() + b[1].sum() - low
    return float(low / total) if total else 0.0


def _verifier(factors, threshold: float):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Those of (a, b, text of a, text of b) that are alike, with their similarity."""
        table = factors.value
        held: tuple[bytes, tuple] | None = None  # the last left text; a star's links come one after the other
        for whole in batches:
            for batch in steps(whole, "text_b"):
                keys, counts, at = _shingle_sets(batch.column(3))
                weights = counts * table[_bucket(keys)]
                out = []
                for i, a in enumerate(batch.column(0).to_pylist()):
                    if held is None or held[0] != a:
                        k, c, _ = _shingle_sets(batch.column(2).slice(i, 1))
                        held = (a, (k, c * table[_bucket(k)]))
                    out.append(weighted_jaccard(held[1], (keys[at[i] : at[i + 1]], weights[at[i] : at[i + 1]])))
                kept = pa.array([x >= threshold for x in out], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"]).filter(kept)

    return verified


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of a graph's links: labels go to the lesser end and jump to their own label until all links agree."""
    ends = [pa.concat_arrays(list(c)).cast(pa.binary()) for c in zip(*[b.columns for b in batches], strict=True)]
    if not ends:
        return
    names = pa.concat_arrays(ends).unique()
    names = names.take(pc.sort_indices(names))
    a, b = (pc.index_in(x, names).to_numpy(zero_copy_only=False).astype(np.int64) for x in ends)
    label = np.arange(len(names))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            break
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(label))], names=["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of undirected ``links`` (a, b; written already): a component's name is its least node."""
    pairs = links.select("a", "b")
    if pairs.limit(LINKS_AT_ONCE + 1).count() > LINKS_AT_ONCE:
        return _joined_components(links)
    return cut(pairs.repartition(1).mapInArrow(_united, "node binary, component binary"))


def _joined_components(links: DataFrame) -> DataFrame:
    """``components`` by joins. Nodes start with their least neighbour. Links between different labels are a smaller graph, whose
    labels hook to their least neighbour and jump to where that one hooks, until no such link is left; a star needs no round."""
    pairs = cut(links.select("a", "b").distinct())
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        left, right = labels.toDF("a", "la"), labels.toDF("b", "lb")
        across = cut(join_unique(join_unique(pairs, left, "a"), right, "b", pairs).where("la != lb").select("la", "lb").distinct())
        if not across.limit(1).count():
            return labels
        ends = across.unionByName(across.select(F.col("lb").alias("la"), F.col("la").alias("lb")))
        hook = ends.groupBy("la").agg(F.min("lb").alias("to")).select(F.col("la").alias("component"), F.least("la", "to").alias("to"))
        jump = hook.select(F.col("component").alias("to"), F.col("to").alias("further"))
        hook = hook.join(jump, "to", "left").select("component", F.coalesce("further", "to").alias("to"))
        labels = cut(join_unique(labels, hook, "component", how="left").select("node", F.coalesce("to", "component").alias("component")))


def small(rows: DataFrame) -> DataFrame:
    """``rows`` (written already) to be sent to the tasks if there are at most ``BROADCAST_NAMES`` of them; else as they are, for a join by a shuffle."""
    return F.broadcast(rows) if rows.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES else rows


def join_unique(many: DataFrame, one: DataFrame, key: str, keys: DataFrame | None = None, how: str = "inner", piece: int = 256) -> DataFrame:
    """``many`` joined with ``one``, which has a row for each ``key``: of a key with more than ``piece`` rows, the rows are dealt to
    several tasks by their hash, and the row of ``one`` goes to each of them. ``keys``: what to count keys in, if not in ``many``."""
    hot = cut((many if keys is None else keys).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > piece).withColumn("_n", F.ceil(F.col("_n") / piece).cast("int")))
    if not hot.limit(1).count():
        return many.join(one, key, how)
    hot = small(hot)
    dealt = many.join(hot, key, "left").withColumn("_deal", F.coalesce(F.pmod(F.xxhash64(*[c for c in many.columns if c != key]), F.col("_n")).cast("int"), F.lit(0))).drop("_n")
    copied = one.join(hot, key, "left").withColumn("_deal", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_n")
    return dealt.join(copied, [key, "_deal"], how).drop("_deal")


def _texts_of(wanted: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of all ``wanted`` nodes, each once: only the row with the least id is fetched, so a group of copies is spread by its ids."""
    rows = cut(wanted.select("node").distinct().join(nodes.select("node", "rep"), "node").toDF("_n", "_r"))
    texts = docs.join(small(rows), (F.col("node") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("_r"))).select("node", "text")
    return texts.dropDuplicates(["node"])


def near_links(docs: DataFrame, nodes: DataFrame, factors, threshold: float) -> DataFrame:
    """Verified links (a, b, similarity), a < b, between ``nodes``: as many as join all that are alike into components, and those of the stars."""
    members = nodes.select(F.posexplode("bands").alias("band", "key"), "node", "samples", "size")
    # A bucket's count and its least node with its samples are made of partial ones, so a large bucket is never in one place.
    buckets = cut(members.groupBy("key").agg(F.min(F.struct("node", "samples")).alias("center"), F.count("*").alias("n")).where("n > 1"))
    members = cut(members.join(small(buckets), "key"))
    star = members.where(F.col("node") != F.col("center.node")).select(F.col("center.node").alias("a"), F.col("node").alias("b"), "center.samples", F.col("samples").alias("s"))
    near = cut(star.mapInArrow(_agreeing, "a binary, b binary").distinct())
    texts = cut(_texts_of(near.select(F.explode(F.array("a", "b")).alias("node")), docs, nodes))
    pairs = join_unique(join_unique(near, texts.toDF("b", "text_b"), "b"), texts.toDF("a", "text_a"), "a", near).select("a", "b", "text_a", "text_b")
    links = cut(pairs.mapInArrow(_verifier(factors, threshold), "a binary, b binary, similarity double"))
    named = members.select("key", "band", "node", "size").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = named.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    # Of a bucket with several components: its largest one, and what that one and the others hold.
    mixed = sizes.groupBy("key").agg(F.max(F.struct("n", "component", "size")).alias("big"), F.sum("n").alias("n"), F.sum("size").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    mixed = cut(mixed.select("key", F.col("big.component").alias("big"), blocks(F.col("big.n"), F.col("big.size")).alias("of_big"), blocks(F.col("n") - F.col("big.n"), F.col("all") - F.col("big.size")).alias("of_rest")))
    if not mixed.limit(1).count():
        return links
    named = cut(named.drop("size").join(small(mixed), "key").join(nodes.select("node", "bands"), "node"))
    sets = cut(_texts_of(named, docs, nodes).mapInArrow(_pack, "node binary, set binary"))
    rows = _dealt(named).join(sets, "node").select("group", "band", "side", "probe", "node", "component", "bands", "set")
    rows = rows.repartition("group").sortWithinPartitions("group")
    return cut(links.unionByName(rows.mapInArrow(_joiner(factors, threshold), "a binary, b binary, similarity double")))


def _dealt(members: DataFrame) -> DataFrame:
    """The rows of mixed buckets dealt to groups of at most two blocks: each block of the nodes outside the largest component
    against each block of that one, and against each block of its own kind."""
    block_of = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.alias("side"))
    rest, own = block_of("of_rest"), block_of("of_big")
    of_big = F.transform(upto("of_rest"), lambda y: at(0, own, y, F.lit(0)))
    of_rest = F.concat(F.transform(upto("of_big"), lambda x: at(0, x, rest, F.lit(1))), F.transform(upto("of_rest"), lambda y: at(1, F.least(y, rest), F.greatest(y, rest), rest)))
    is_big = F.col("component") == F.col("big")
    each = members.withColumn("at", F.explode(F.when(is_big, of_big).otherwise(of_rest)))
    return each.select(F.xxhash64("key", "at.kind", "at.x", "at.y").alias("group"), "band", F.col("at.side").alias("side"), (~is_big).alias("probe"), "node", "component", "bands")


def _prepared(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), node_of(whole).alias("node"), whole.alias("text"))


def node_of(text: Column) -> Column:
    """The name of a text: equal texts, and only they, have the same."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of ``docs``: (doc_id, node) of all rows, (node, rep, component, class_id, n_copies) of all texts, and verified links between texts, as many as make the classes."""
    source = _prepared(docs, doc_id, text)
    spark = docs.sparkSession
    factors = spark.sparkContext.broadcast(idf_table(source))  # 2**SKETCH_BITS floats
    signed = cut(source.mapInArrow(_signer(factors), "doc_id long, node binary, bands array<bigint>, samples binary, size long"))
    counts = signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"))
    first = signed.join(counts.withColumnRenamed("node", "_n"), (F.col("node") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("rep"))).drop("_n")
    nodes = cut(first.dropDuplicates(["node"]).select("node", "rep", "n_copies", "bands", "samples", "size"))
    links = near_links(source, nodes, factors, threshold)
    factors.unpersist()
    labelled = nodes.select("node", "rep", "n_copies").join(components(links), "node", "left")
    labelled = cut(labelled.withColumn("component", F.coalesce("component", "node")))
    least = labelled.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = cut(join_unique(labelled, least, "component").select("node", "rep", "component", "class_id", "n_copies"))
    return signed.select("doc_id", "node"), named, links


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document: its class (the least id of all that are alike), whether it stands for it, and the copies of its text."""
    rows, named, _ = classes(docs, doc_id, text, threshold)
    out = join_unique(rows, named, "node")
    return out.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"), "n_copies")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: the one with the least id (null last); of rows that repeat that id and text, one."""
    _, named, _ = classes(docs, doc_id, text, threshold)
    best = named.groupBy("component").agg(F.min(F.struct(F.col("rep").isNull().alias("void"), "rep", "node")).alias("w"))
    winners = best.select(F.col("w.node").alias("__winner_node"), F.col("w.rep").alias("__winner_id"))
    marked = docs.withColumn("__node", node_of(F.col(text)))
    kept = marked.join(winners, (F.col("__node") == F.col("__winner_node")) & F.col(doc_id).cast("long").eqNullSafe(F.col("__winner_id")))
    return kept.dropDuplicates([doc_id, "__node"]).select(*[f"`{c}`" for c in docs.columns])
