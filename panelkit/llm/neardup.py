"""MinHash near-duplicates with odd sketches (operator 8).

1. Texts become sets of word shingles (64-bit hashes, made by numpy over whole Arrow batches). Texts of one set form a
   class at once, by a grouped minimum, so copies never meet in pairs.
2. Each class has BANDS x ROWS MinHash samples. A band's hash is its bucket; the samples also fold into a parity bitmap
   (odd sketch) in which the XOR of two sketches estimates how many samples differ.
3. Every bucket links its members to its smallest one, its centre: linear in members, not pairs. Components of these
   unconfirmed links are the clusters; whatever shares a bucket is in one cluster.
4. Each class is compared, on full sets, with the centre whose sketch is nearest to its own. This joins most of a large
   group of near copies at the price of one comparison a member. What these links connect has one label.
5. In clusters of several labels, sketches alone (64 bytes a class) are compared in pairs of blocks, those of the
   commonest label never with each other. Pairs of two labels that pass the sizes and the XOR population count are
   candidates, which full sets decide. What counts is who is linked, so a spanning forest of links comes out.
6. Components of the confirmed links are the result.

With 40 bands of 6 rows, a pair of Jaccard similarity 0.8 shares no bucket with probability 5e-6; the sketch screen
keeps a pair of 0.8 but for about 3e-7.

Defined results: texts that are null or hold no word have empty sets and stay alone; repeated rows are copies; a null
doc_id can stay alone or join a component but never names one; two rows of one doc_id are linked by their texts alone;
a text of any length is one set, of 8 bytes a shingle, and blocks are dealt by shingles as well as by rows; an empty
table gives an empty result; other columns, whatever their names, are ignored by near_duplicates() and kept by
first_of_each().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, discard, salted_left_join, small_batches
from .shingles import mixed, pieces, shingle_sets

BANDS, ROWS = 40, 6
SAMPLES = BANDS * ROWS
BITS = 512
WORDS = BITS // 64
#: Sketch distance up to which a pair is confirmed: five deviations above what similarity 0.8 gives.
MOST_BITS = 135
#: Classes, and shingles, in a block.
BLOCK, BLOCK_SHINGLES = 1024, 500_000
#: Bytes of text whose samples a worker holds at once, and rows of an Arrow batch of texts.
AT_ONCE, ROWS_AT_ONCE = 250_000, 500

_rng = np.random.RandomState(20240229)
_A = (_rng.randint(0, 1 << 31, SAMPLES).astype(np.uint32) << 1) | np.uint32(1)
_B = _rng.randint(0, 1 << 31, SAMPLES).astype(np.uint32)


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash samples (n x SAMPLES, uint32) of non-empty sets that stand one after another."""
    out = np.empty((len(offsets) - 1, SAMPLES), dtype=np.uint32)
    if len(out):
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        for i in range(SAMPLES):
            out[:, i] = np.minimum.reduceat(x * _A[i] + _B[i], offsets[:-1])
    return out


def band_hashes(samples: np.ndarray) -> np.ndarray:
    """One bucket (int64) for each band."""
    grouped = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(samples), BANDS)).copy()
    for r in range(ROWS):
        out = mixed(out + grouped[:, :, r])
    return out.view(np.int64)


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity bitmaps (n x WORDS, uint64): sample i flips the bit that (i, its value) hashes to."""
    seeds = np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)
    place = (mixed(samples.astype(np.uint64) + seeds) >> np.uint64(64 - 9)).astype(np.int64)
    bits = np.zeros((len(samples), BITS), dtype=np.uint8)
    rows = np.arange(len(samples))
    for i in range(SAMPLES):
        bits[rows, place[:, i]] ^= 1
    return np.packbits(bits, axis=1).view(np.uint64)


def _fixed_lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.reshape(-1)))


def _summaries(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end in pieces(batch.column("text"), AT_ONCE):
            part = batch.slice(begin, end - begin)
            hashes, at = shingle_sets(part.column("text"), width)
            sizes = np.diff(at)
            full = np.flatnonzero(sizes)
            samples = signatures(hashes, np.concatenate([at[:-1][full], at[-1:]]))
            digest = [hashlib.blake2b(hashes[at[i] : at[i + 1]].tobytes(), digest_size=16).digest() for i in full.tolist()]
            where = np.full(len(part), -1)
            where[full] = np.arange(len(full))
            take = pa.array(where, mask=where < 0, type=pa.int64())
            keys = np.frombuffer(b"".join(digest), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("jk"),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(keys[:, 0]).take(take),
                    pa.array(keys[:, 1]).take(take),
                    _fixed_lists(band_hashes(samples)).take(take),
                    _fixed_lists(odd_sketches(samples).view(np.int64)).take(take),
                ],
                ["doc_id", "jk", "n_shingles", "d1", "d2", "bands", "sketch"],
            )


def row_hash() -> Column:
    """With doc_id, what tells rows apart that differ in id or text."""
    return F.xxhash64("doc_id", "text")


def summarise(docs: DataFrame, width: int) -> DataFrame:
    """Row by row: doc_id, jk (hash of id and text), n_shingles, d1 and d2 (the set's digest; null if empty), bands, sketch."""
    rows = docs.select("doc_id", "text", row_hash().alias("jk"))
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    schema = f"doc_id {kind}, jk bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, sketch array<bigint>"
    return small_batches(rows, ROWS_AT_ONCE).mapInArrow(lambda batches: _summaries(batches, width), schema)


def _alike(sizes: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Whether sets of these sizes can reach the similarity at all."""
    return 100 * np.minimum(sizes, size) >= percent * np.maximum(sizes, size)


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Sorted rows -> one table for each run of equal keys."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not len(batch):
            continue
        key = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in keys], axis=1)
        edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for a, b in zip(edges[:-1], edges[1:]):
            own = tuple(key[a].tolist())
            if held and own != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = own
    if held:
        yield pa.Table.from_batches(held)


def _shared(one: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of `one` with non-empty sets."""
    joined = np.concatenate(sets)
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    found = one[np.minimum(np.searchsorted(one, joined), len(one) - 1)] == joined
    return np.add.reduceat(found.astype(np.int64), at)


def _sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    out = []
    for begin, end in pieces(texts):
        hashes, at = shingle_sets(texts.slice(begin, end - begin), width)
        out += [hashes[at[k] : at[k + 1]] for k in range(end - begin)]
    return out


def _starred(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (centre, salt, member), the centre itself first: confirmed links of members to their centre."""
    centre, own = None, None
    for batch in batches:
        centres, nodes, member = (np.asarray(batch.column(c)) for c in ("centre", "node", "member"))
        links: list[tuple[int, int]] = []
        for begin, end in pieces(batch.column("text")):
            sets = _sets(batch.column("text").slice(begin, end - begin), width)
            for k, s in enumerate(sets, begin):
                if not member[k]:
                    centre, own = centres[k], s
                elif _alike(np.array([len(s)]), len(own), percent)[0]:
                    both = int(_shared(own, [s])[0])
                    if 100 * both >= percent * (len(s) + len(own) - both):
                        links.append((int(centre), int(nodes[k])))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])


def _halves(group: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """The group by (block, node), each node once, and the places of its two blocks (the same, if it is one)."""
    i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    block, node = np.asarray(group.column("block")), np.asarray(group.column("node"))
    order = np.lexsort((node, block))
    order = order[np.concatenate([[True], node[order][1:] != node[order][:-1]])]
    block = block[order]
    everyone = np.arange(len(order))
    return group.take(pa.array(order)), *((everyone, everyone) if i == j else (everyone[block == i], everyone[block == j]))


def _screened(batches: Iterator[pa.RecordBatch], percent: int, most_bits: int) -> Iterator[pa.RecordBatch]:
    """Blocks of sketches -> the classes that have a candidate of another label in the pair of blocks."""
    for group in _groups(batches, ("cluster", "i", "j")):
        group, left, right = _halves(group)
        if not len(left) or not len(right):
            continue
        sketch = np.asarray(group.column("sketch").combine_chunks().flatten()).view(np.uint64).reshape(-1, WORDS)
        size, label, node = (np.asarray(group.column(c)) for c in ("n_shingles", "label", "node"))
        hit = np.zeros(len(node), bool)
        for x in left.tolist():
            near = right[(label[right] != label[x]) & _alike(size[right], size[x], percent)]
            near = near[np.bitwise_count(sketch[near] ^ sketch[x]).sum(axis=1, dtype=np.int64) <= most_bits]
            hit[near] = True
            hit[x] |= len(near) > 0
        if hit.any():
            yield from group.select(["cluster", "i", "j", "block", "node", "label"]).take(pa.array(np.flatnonzero(hit))).combine_chunks().to_batches()


def _confirmed(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cluster, i, j): in each pair of blocks, links of different labels as a spanning forest."""
    for group in _groups(batches, ("cluster", "i", "j")):
        group, left, right = _halves(group)
        nodes, labels = np.asarray(group.column("node")), np.asarray(group.column("label"))
        sets = _sets(group.column("text").combine_chunks(), width)
        size = np.array([len(s) for s in sets])
        parent = np.unique(labels, return_inverse=True)[1]  # rows of one label are joined already

        links = []
        for x in left.tolist():
            js = right[(parent[right] != parent[x]) & _alike(size[right], size[x], percent)]
            if not len(js):
                continue
            both = _shared(sets[x], [sets[y] for y in js.tolist()])
            for y in js[100 * both >= percent * (size[x] + size[js] - both)].tolist():
                if parent[y] != parent[x]:
                    parent[parent == parent[y]] = parent[x]
                    links.append((nodes[x], nodes[y]))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["a", "b"])


def _apart(a: str, b: str) -> Column:
    """Population count of two sketches' XOR."""
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(WORDS)), F.lit(0))


def _parts(rows: Column, shingles: Column, block: int) -> Column:
    return F.greatest(F.ceil(rows / block), F.ceil(shingles / BLOCK_SHINGLES), F.lit(1)).cast("int")


def _with_text(rows: DataFrame, texts: DataFrame, broadcast_rows: int) -> DataFrame:
    """rows with the text of their node. Rows are broadcast up to so many, so that texts are not shuffled for the join."""
    few = rows.limit(broadcast_rows + 1).count() <= broadcast_rows
    return texts.join(F.broadcast(rows) if few else rows, "node")


def _star_links(pairs: DataFrame, texts: DataFrame, width: int, percent: int, block: int, broadcast_rows: int) -> DataFrame:
    """(node, centre) pairs -> those whose full sets are alike. A centre's members are dealt to groups of about `block`."""
    parts = pairs.groupBy("centre").agg(_parts(F.count("*"), F.sum("n_shingles"), block).alias("p"))
    sized = pairs.join(parts, "centre")
    members = sized.select("centre", "node", F.pmod(F.xxhash64("node"), F.col("p")).cast("int").alias("salt"), F.lit(True).alias("member"))
    centres = parts.select("centre", F.col("centre").alias("node"), F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("salt"), F.lit(False).alias("member"))
    rows = _with_text(members.unionByName(centres), texts, broadcast_rows)
    dealt = small_batches(rows).repartition("centre", "salt").sortWithinPartitions("centre", "salt", "member")
    return cut(dealt.mapInArrow(lambda b: _starred(b, width, percent), "a bigint, b bigint"))


def _screen(held: DataFrame, labels: DataFrame, percent: int, block: int) -> DataFrame:
    """Classes that have candidates of another label, by pairs of blocks of their clusters."""
    state = cut(held.join(labels, "node", "left").select("cluster", "node", "n_shingles", "sketch", F.coalesce("root", "node").alias("label")))
    by_label = state.groupBy("cluster", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    largest = F.max_by(F.struct("label", "n", "s"), F.struct("n", "label"))
    clusters = by_label.groupBy("cluster").agg(largest.alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("labels")).where("labels > 1")
    clusters = clusters.select("cluster", F.col("main.label").alias("main"), _parts(F.col("main.n"), F.col("main.s"), block).alias("p"), _parts(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s"), block).alias("q"))
    rows = state.join(clusters, "cluster").withColumn("is_main", F.col("label") == F.col("main"))
    rows = rows.withColumn("block", F.when(F.col("is_main"), F.pmod(F.xxhash64("node"), F.col("p"))).otherwise(F.col("p") + F.pmod(F.xxhash64("node"), F.col("q"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(F.col("is_main"), F.col("p")).otherwise(F.lit(0)), F.col("p") + F.col("q") - 1)))
    rows = rows.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "label", "n_shingles", "sketch")
    dealt = rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    schema = "cluster bigint, i int, j int, block int, node bigint, label bigint"
    found = cut(dealt.mapInArrow(lambda b: _screened(b, percent, MOST_BITS), schema))
    discard(state)
    return found


def _links(docs: DataFrame, classes: DataFrame, width: int, percent: int, block: int, broadcast_rows: int) -> DataFrame:
    """(a, b) confirmed links of classes, enough to connect whatever is linked."""
    member = classes.select("node", F.explode("bands").alias("band"))
    bucket = member.groupBy("band").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last").select("band", "centre")
    homes = cut(member.join(bucket, "band").groupBy("node").agg(F.collect_set("centre").alias("centres")))  # BANDS at most
    near = homes.select(F.array_min("centres").alias("a"), F.explode(F.array_union("centres", F.array("node"))).alias("b"))
    clusters = components(near).withColumnRenamed("root", "cluster")
    held = cut(clusters.join(classes.select("node", "doc_id", "jk", "n_shingles", "sketch"), "node"))

    needed = held.select("node", F.col("doc_id").alias("own_id"), "jk")
    few = held.limit(broadcast_rows + 1).count() <= broadcast_rows
    own = docs.select("doc_id", row_hash().alias("own_jk"), "text")
    same = (F.col("own_jk") == F.col("jk")) & F.col("doc_id").eqNullSafe(F.col("own_id"))
    texts = cut(own.join(F.broadcast(needed) if few else needed, same).select("node", "text"))  # twice read, never shuffled whole if few

    mine = held.select("node", "n_shingles", "sketch")
    centre = held.select(F.col("node").alias("centre"), F.col("n_shingles").alias("centre_shingles"), F.col("sketch").alias("centre_sketch"))
    tried = homes.select("node", F.explode("centres").alias("centre")).where("node <> centre").join(mine, "node").join(centre, "centre")
    tried = tried.where(100 * F.least("n_shingles", "centre_shingles") >= percent * F.greatest("n_shingles", "centre_shingles"))
    tried = tried.select("node", "centre", "n_shingles", _apart("sketch", "centre_sketch").alias("apart")).where(F.col("apart") <= MOST_BITS)
    nearest = cut(tried.groupBy("node").agg(F.min(F.struct("apart", "centre")).alias("x"), F.first("n_shingles").alias("n_shingles")).select("node", F.col("x.centre").alias("centre"), "n_shingles"))
    links = _star_links(nearest, texts, width, percent, block, broadcast_rows)
    discard(homes, nearest)

    screened = _screen(held, components(links), percent, block)
    if not screened.isEmpty():
        rows = _with_text(screened.select("cluster", "i", "j", "block", "node", "label"), texts, broadcast_rows)
        dealt = small_batches(rows).repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
        links = cut(links.union(dealt.mapInArrow(lambda batches: _confirmed(batches, width, percent), "a bigint, b bigint")))
    discard(held, texts, screened)
    return links


def grouped(docs: DataFrame, width: int = 5, percent: int = 80, block: int = BLOCK, broadcast_rows: int = 200_000) -> DataFrame:
    """Per row: doc_id, jk, n_shingles, component_id, and group (a number of its component; null if the row is alone)."""
    rows = cut(summarise(docs.select("doc_id", "text"), width))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "jk")).alias("rep")
    classes = rows.where("d1 is not null").groupBy("d1", "d2").agg(rep, F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("bands", "sketch", "n_shingles")])
    classes = cut(classes.select(F.monotonically_increasing_id().alias("node"), "d1", "d2", F.col("rep.doc_id").alias("doc_id"), F.col("rep.jk").alias("jk"), "copies", "n_shingles", "bands", "sketch"))

    roots = components(_links(docs, classes, width, percent, block, broadcast_rows))
    named = classes.join(roots, "node", "left").where("root is not null or copies > 1").select("d1", "d2", "doc_id", F.coalesce("root", "node").alias("group"))
    named = cut(named)
    smallest = named.groupBy("group").agg(F.min("doc_id").alias("least"))
    labels = cut(named.join(smallest, "group").select("d1", "d2", "group", "least"))
    discard(classes, named)
    out = salted_left_join(rows.select("doc_id", "jk", "n_shingles", "d1", "d2"), labels, ["d1", "d2"], F.struct("doc_id", "jk"))
    return out.select("doc_id", "jk", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"), "group")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, block: int = BLOCK, broadcast_rows: int = 200_000) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable over links; null if all are).

    block: classes compared at once. broadcast_rows: classes whose texts are needed are broadcast up to so many; beyond
    that the texts are shuffled.
    """
    return grouped(docs, width, percent, block, broadcast_rows).select("doc_id", "n_shingles", "component_id")


def first_of_each(docs: DataFrame, width: int = 5, percent: int = 80, broadcast_rows: int = 200_000) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (null last), then by hashes of text and row.

    broadcast_rows: ids of rows to drop are broadcast up to so many; beyond that docs are shuffled for the join.
    """
    found = cut(grouped(docs, width, percent).where("group is not null").select("group", "doc_id", "jk"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "jk")
    first = found.groupBy("group").agg(F.min(order).alias("first"))
    marked = found.join(first, "group").groupBy("doc_id", "jk").agg(F.max(order == F.col("first")).alias("stays"), F.count("*").alias("n"))
    marked = cut(marked.where("not stays or n > 1").select(F.col("doc_id").alias("found_id"), F.col("jk").alias("found_jk"), "stays"))
    marked = F.broadcast(marked) if marked.limit(broadcast_rows + 1).count() <= broadcast_rows else marked
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), row_hash().alias("own_jk"))
    same = (F.col("own_jk") == F.col("found_jk")) & F.col("own_id").eqNullSafe(F.col("found_id"))
    kept = rows.join(marked, same, "left_anti")
    repeated = rows.join(marked.where("stays"), same, "left_semi")
    nth = F.row_number().over(Window.partitionBy("own_id", "own_jk").orderBy(F.xxhash64(F.to_json("row"))))
    once = repeated.withColumn("nth", nth).where("nth = 1").drop("nth")
    return kept.unionByName(once).select("row.*")
