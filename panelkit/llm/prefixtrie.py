"""Conversation prefix trie as a z-fast trie in tables (operator 12).

Conversations are sequences of turns. A sequence's prefix of d turns has a 128-bit sum, over its turns, of hashes of
(place, role, text digest): sums of prefixes can be taken in blocks and one turn be taken off again, so no sequence is
ever gathered in one row. Equal sequences are one key, named by its smallest conv_id.

The trie holds compacted nodes: prefixes at which keys end or part. A node covers the depths from its parent's (excluded)
to its own, and is filed under its handle: its prefix at the two-fattest number of that interval (the one divisible by the
largest power of two). Keys go in in BATCHES batches, each several times larger than the last:

1. locate(): a fat binary search by joins. A key's search interval is (lo, hi]; its prefix at the interval's two-fattest
   number is looked up among the handles; a hit moves lo to the node's depth, a miss moves hi below. The node that is
   left, or its child by the next turn, is the exit node; how far the key follows its edge is found against the edge.
2. insert(): an edge that a key leaves is split there; below that, new keys part where a prefix has two next turns; every
   key ends in a node. Parents, handles and the names of edges are then set anew from the keys' paths.

Edges are expanded at the end: each depth of an edge is a node with the edge's members.

Defined results: rows whose conv_id is null are ignored; turns in a tie go by role, then by the MD5 of the text; repeated
rows are turns of their own; a null role or text is an empty one; a text of any length is digested whole; a conversation
of very many turns is numbered and summed in blocks of SPAN turns; an empty table gives an empty result (no root); other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, discard, salted_left_join

#: Turns numbered, and summed, in one window group.
SPAN = 1024
BATCHES = 2
#: Each batch but the last holds one in FEWER of what the next ones hold.
FEWER = 8
#: Rows of paths in a partition.
PATHS = 500_000
P = ["p1", "p2"]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the largest power of two divides; low is 0 or more."""
    bits = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits)


def _before(sums: DataFrame, block: str, names: list[str]) -> DataFrame:
    """Running sums of a conversation's blocks before each one."""
    w = Window.partitionBy("conv_id").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumns({f"{n}_before": F.coalesce(F.sum(n).over(w), F.lit(0)) for n in names})


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, digest, words, n (turns of the conversation), base_n (turns of conversation c - c % 20)."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), F.unhex(F.md5(text)).alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    block = F.coalesce(F.floor(F.col("turn") / SPAN), F.lit(-(2**62))).alias("block")
    counts = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), block).groupBy("conv_id", "block").agg(F.count("*").alias("m"))
    whole = Window.partitionBy("conv_id")
    blocks = _before(counts, "block", ["m"]).withColumn("n", F.sum("m").over(whole))
    bases = blocks.where("conv_id % 20 = 0").groupBy(F.col("conv_id").alias("base")).agg(F.first("n").alias("base_n"))
    blocks = blocks.withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(bases, "base", "left").select("conv_id", "block", "m_before", "n", F.coalesce("base_n", F.lit(0)).alias("base_n"))
    order = Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    rows = turns.select("*", block).join(blocks, ["conv_id", "block"])
    return rows.select("conv_id", (F.row_number().over(order) + F.col("m_before")).cast("long").alias("pos"), "role", "digest", "words", "n", "base_n")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after the exchange of first turns: conv_id, depth, role, digest, words, len; and conv_id, len of all."""
    first = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    taken = F.least("h", "base_n")
    known = rows.withColumn("h", first)
    length = (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + taken).alias("len")
    own = known.where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + taken).alias("depth"), "role", "digest", "words", length)
    ids = known.where("pos = 1").select("conv_id", "h", length)
    heads = rows.where("conv_id % 20 = 0 and pos <= 3").select(F.col("conv_id").alias("base"), "pos", "role", "digest", "words")
    lent = ids.where("h > 0").withColumn("base", F.col("conv_id") - F.col("conv_id") % 20).join(heads, "base").where("pos <= h")
    return own.unionByName(lent.select("conv_id", F.col("pos").alias("depth"), "role", "digest", "words", "len")), ids.select("conv_id", "len")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, len, p1 and p2 (the prefix), q1 and q2 (the prefix one turn shorter), words up to and of the turn."""
    hashes = [F.xxhash64(F.lit(seed), "depth", "role", "digest") for seed in (1, 2)]
    lanes = {f"l{2 * i + k}": (F.shiftrightunsigned(h, 32) if k == 0 else h.bitwiseAND(F.lit(0xFFFFFFFF))) for i, h in enumerate(hashes) for k in (0, 1)}
    rows = turns.withColumns(lanes).withColumn("block", F.floor((F.col("depth") - 1) / SPAN)).drop("role", "digest")
    names = [*lanes, "words"]
    carried = _before(rows.where(F.col("len") > SPAN).groupBy("conv_id", "block").agg(*[F.sum(n).alias(n) for n in names]), "block", names).drop(*names)
    w = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.join(carried, ["conv_id", "block"], "left").withColumns({f"s_{n}": F.sum(n).over(w) + F.coalesce(f"{n}_before", F.lit(0)) for n in names})

    def joined(high: Column, low: Column) -> Column:
        keep = F.lit(0xFFFFFFFF)
        return F.shiftleft(high.bitwiseAND(keep), 32).bitwiseOR(low.bitwiseAND(keep))

    pairs = {f"{name}{i + 1}": joined(*[F.col(f"s_l{2 * i + k}") - (F.col(f"l{2 * i + k}") if name == "q" else 0) for k in (0, 1)]) for name in "pq" for i in (0, 1)}
    return sums.select("conv_id", "depth", "len", *[v.alias(k) for k, v in pairs.items()], F.col("s_words").alias("upto"), "words")


class Trie:
    """Keys, their paths and the compacted nodes of the batches that are in.

    keys: key (smallest conv_id of the sequence), p1, p2, len, n (conversations), batch.
    paths: key, depth (0: the root), p1, p2, q1, q2, upto (words of the turns so far), batch; kept partitioned by (key, depth).
    nodes: p1, p2, depth, up (parent's depth; -1: the root), u1, u2 (parent's prefix), key (a key below), h1, h2 (handle), e1, e2 (prefix
    one turn below the parent: the edge's name).
    """

    def __init__(self, prefix: DataFrame, conversations: DataFrame, batches: int = BATCHES) -> None:
        self.batches = batches
        ends = prefix.where("depth = len").select("conv_id", "len", *P)
        turnless = conversations.where("len = 0").select("conv_id", "len", F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"))
        self.ends = cut(ends.unionByName(turnless))
        dealt = F.pmod(F.xxhash64(*P), F.lit(FEWER ** (batches - 1)))
        batch = F.lit(0)
        for b in range(1, batches):
            batch = F.when(dealt >= FEWER ** (b - 1), F.lit(b)).otherwise(batch)
        self.keys = cut(self.ends.groupBy(*P, "len").agg(F.min("conv_id").alias("key"), F.count("*").alias("n")).withColumn("batch", batch))
        owners = self.keys.select(F.col("key").alias("conv_id"), "batch")
        turns = prefix.join(owners.hint("shuffle_hash"), "conv_id").select(F.col("conv_id").alias("key"), "depth", "p1", "p2", "q1", "q2", "upto", "batch")
        zero = F.lit(0).cast("long")
        tops = self.keys.select("key", zero.alias("depth"), *[zero.alias(c) for c in ("p1", "p2", "q1", "q2", "upto")], "batch")
        rows = self.ends.agg(F.sum(F.col("len") + 1)).first()[0] or 0
        spread = max(-(-rows // PATHS), min(prefix.sparkSession.sparkContext.defaultParallelism, 1 + rows // 10_000))
        self.paths = turns.unionByName(tops).repartition(spread, "key", "depth").persist()
        self.nodes: DataFrame | None = None

    def build(self) -> DataFrame:
        """The nodes with all keys in. The last batch's handles are columns like the others', worked out only if asked for."""
        for b in range(self.batches):
            batch = self.keys.where(F.col("batch") == b)
            if self.nodes is None:
                exits = batch.select("key", F.lit(0).cast("long").alias("match"), F.lit(False).alias("inside"))
            else:
                exits = cut(self.locate(batch))
            self.insert(batch, exits, b)
        return self.nodes

    def at(self, rows: DataFrame, key: str, depth: str, **names: str) -> DataFrame:
        """rows with columns of the path of `key` at `depth`."""
        path = self.paths.select(F.col("key").alias("_k"), F.col("depth").alias("_d"), *[F.col(c).alias(n) for n, c in names.items()])
        # the paths stay where they are; the rows are sent to them
        return rows.hint("shuffle_hash").join(path, (F.col(key) == F.col("_k")) & (F.col(depth) == F.col("_d"))).drop("_k", "_d")

    def locate(self, batch: DataFrame) -> DataFrame:
        """key, match (turns that it shares with the trie), inside (whether that is inside an edge)."""
        handles = self.nodes.where("up >= 0").select("h1", "h2", *[F.col(c).alias(f"f_{c}") for c in ("p1", "p2", "depth", "up", "key")])
        zero = F.lit(0).cast("long")
        state = batch.select("key", "len", zero.alias("lo"), F.col("len").alias("hi"), zero.alias("t_p1"), zero.alias("t_p2"), zero.alias("t_depth"), F.lit(-1).cast("long").alias("t_up"), zero.alias("t_key"))
        done = None
        while True:
            going = self.at(state.where("lo < hi").withColumn("f", two_fattest(F.col("lo"), F.col("hi"))), "key", "f", h1="p1", h2="p2")
            met = going.join(handles.hint("shuffle_hash"), ["h1", "h2"], "left")
            hit = F.col("f_depth").isNotNull()
            moved = met.select(
                "key", "len", F.when(hit, F.least("f_depth", "hi")).otherwise(F.col("lo")).alias("lo"), F.when(hit, F.col("hi")).otherwise(F.col("f") - 1).alias("hi"),
                *[F.when(hit, F.col(f"f_{c}")).otherwise(F.col(f"t_{c}")).alias(f"t_{c}") for c in ("p1", "p2", "depth", "up", "key")],
            )
            over = state.where("lo >= hi")
            done = over if done is None else done.unionByName(over)
            state = cut(moved)
            if state.isEmpty():
                break
        found = done.withColumn("t", F.least("t_depth", "len"))
        found = cut(self.at(found, "key", "t", x1="p1", x2="p2").withColumn("through", (F.col("x1") == F.col("t_p1")) & (F.col("x2") == F.col("t_p2"))))
        within = found.where("not through").select("key", "len", *[F.col(f"t_{c}").alias(c) for c in ("depth", "up")], F.col("t_key").alias("other"))
        # through the node: on to its child by the next turn, where there is one
        ended = found.where("through and t_depth = len").select("key", F.col("len").alias("match"), F.lit(False).alias("inside"))
        names = self.nodes.where("up >= 0").select("e1", "e2", F.col("depth").alias("f_depth"), F.col("up").alias("f_up"), F.col("key").alias("other"))
        more = self.at(found.where("through and t_depth < len").withColumn("next", F.col("t_depth") + 1), "key", "next", e1="p1", e2="p2").join(names.hint("shuffle_hash"), ["e1", "e2"], "left")
        apart = more.where("other is null").select("key", F.col("t_depth").alias("match"), F.lit(False).alias("inside"))
        within = within.unionByName(more.where("other is not null").select("key", "len", F.col("f_depth").alias("depth"), F.col("f_up").alias("up"), "other"))
        # along the edge, turn by turn, as far as both paths agree
        steps = within.withColumn("d", F.explode(F.sequence(F.col("up") + 1, F.least("depth", "len"))))
        both = self.at(self.at(steps, "key", "d", a1="p1", a2="p2"), "other", "d", b1="p1", b2="p2")
        agree = F.when((F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2")), F.col("d"))
        along = both.groupBy("key").agg(F.coalesce(F.max(agree), F.first("up")).alias("match"), F.first("depth").alias("depth"), F.first("up").alias("up"))
        inside = (F.col("match") < F.col("depth")) & (F.col("match") > F.col("up"))
        return ended.unionByName(apart).unionByName(along.select("key", "match", inside.alias("inside")))

    def insert(self, batch: DataFrame, exits: DataFrame, b: int) -> None:
        """Nodes of all batches up to b."""
        mine = self.paths.where(F.col("batch") == b).join(exits.hint("shuffle_hash"), "key")
        split = mine.where("inside and depth = match").select(*P, "depth")
        parting = mine.where("depth > match + 1").groupBy("q1", "q2", "depth").agg(F.min(F.struct(*P)).alias("least"), F.max(F.struct(*P)).alias("most"))
        parting = parting.where("least <> most").select(F.col("q1").alias("p1"), F.col("q2").alias("p2"), (F.col("depth") - 1).alias("depth"))
        marked = split.unionByName(parting).unionByName(batch.select(*P, F.col("len").alias("depth")))
        zero = F.lit(0).cast("long")
        marked = marked.unionByName(self.keys.limit(1).select(zero.alias("p1"), zero.alias("p2"), zero.alias("depth")))  # the root
        if self.nodes is not None:
            marked = marked.unionByName(self.nodes.select(*P, "depth"))
        explicit = cut(marked.distinct())
        self.marks = cut(self._marks(explicit, b))
        tops = self.marks.groupBy(*P, "depth").agg(F.min("key").alias("key"), F.first("up").alias("up"), F.first("u1").alias("u1"), F.first("u2").alias("u2"))
        below = tops.where("depth > 0").withColumns({"f": two_fattest(F.col("up"), F.col("depth")), "e": F.col("up") + 1})
        edges = self.at(self.at(below, "key", "f", h1="p1", h2="p2"), "key", "e", e1="p1", e2="p2").drop("f", "e")
        nothing = F.lit(None).cast("long")
        self.nodes = edges.unionByName(tops.where("depth = 0").withColumns({c: nothing for c in ("h1", "h2", "e1", "e2")}))
        if b + 1 < self.batches:
            self.nodes = cut(self.nodes)

    def _marks(self, explicit: DataFrame, b: int) -> DataFrame:
        """The nodes on each key's path: key, depth, p1, p2, up, u1, u2 (the node above), upto, above (words up to the node above)."""
        on = salted_left_join(self.paths.where(F.col("batch") <= b).drop("batch", "q1", "q2"), explicit.select(*P, F.lit(True).alias("is_node")).hint("shuffle_hash"), P, F.col("key")).where("is_node")
        w = Window.partitionBy("key").orderBy("depth")
        lag = lambda c, none: F.coalesce(F.lag(c).over(w), F.lit(none).cast("long"))
        return on.select("key", "depth", *P, lag("depth", -1).alias("up"), lag("p1", 0).alias("u1"), lag("p2", 0).alias("u2"), "upto", lag("upto", 0).alias("above"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (p1, p2, conv_id): one SHA-256 of the ids, in decimal with commas, a prefix. Ids are fed to it as they come."""
    last, digest = None, None
    for batch in batches:
        p1, p2, ids = (np.asarray(batch.column(c)) for c in range(3))
        edges = [0, *(np.flatnonzero((p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])) + 1).tolist(), len(ids)]
        out = []
        for a, z in zip(edges[:-1], edges[1:]):
            if a == z:
                continue
            own, body = (int(p1[a]), int(p2[a])), ",".join(map(str, ids[a:z].tolist())).encode()
            if own == last:
                digest.update(b"," + body)
                continue
            if last is not None:
                out.append((*last, digest.hexdigest()))
            last, digest = own, hashlib.sha256(body)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["p1", "p2", "sha"])
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int64()), pa.array([digest.hexdigest()])], ["p1", "p2", "sha"])


def summed(trie: Trie) -> DataFrame:
    """Compacted nodes: p1, p2, depth, up, above, key (smallest member), n_convs, n_children, n_leaves, saved (its whole subtree and edge), top_key (parent's key)."""
    copies = trie.keys.select("key", "n", "len")
    marks = trie.marks.join(copies.hint("shuffle_hash"), "key")
    nodes = cut(marks.groupBy(*P, "depth").agg(F.min("key").alias("owner"), F.sum("n").alias("n_convs"), *[F.first(c).alias(c) for c in ("up", "u1", "u2", "above")], F.first("upto").alias("upto")))
    children = nodes.where("up >= 0").groupBy(F.col("u1").alias("p1"), F.col("u2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children.hint("shuffle_hash"), P, "left").na.fill(0, ["n_children"]))
    # a leaf ends one key; what an edge saves is counted on the path of its smallest member; both go up along the path
    own = F.when(F.col("owner") == F.col("key"), (F.col("n_convs") - 1) * (F.col("upto") - F.col("above"))).otherwise(0)
    leaf = F.when((F.col("depth") == F.col("len")) & (F.col("n_children") == 0), 1).otherwise(0)
    held = salted_left_join(marks, nodes.select(*P, "owner", "n_convs", "n_children").hint("shuffle_hash"), P, F.col("key"))
    below = Window.partitionBy("key").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = held.select(*P, F.sum(own).over(below).alias("saved"), F.sum(leaf).over(below).alias("n_leaves")).groupBy(*P).agg(F.sum("saved").alias("saved"), F.sum("n_leaves").alias("n_leaves"))
    parents = nodes.select(F.col("p1").alias("u1"), F.col("p2").alias("u2"), F.col("owner").alias("top_key"))
    above = salted_left_join(nodes, parents.hint("shuffle_hash"), ["u1", "u2"], F.struct(*P))
    return above.join(sums.hint("shuffle_hash"), P).withColumn("top_key", F.when(F.col("up") >= 0, F.col("top_key"))).withColumnRenamed("owner", "key")


def expanded(trie: Trie, nodes: DataFrame) -> DataFrame:
    """One row for each prefix of any length, from the nodes' edges."""
    ends = trie.ends.select(*P, "conv_id").repartition(*P).sortWithinPartitions(*P, "conv_id")
    digests = ends.mapInArrow(_hashed, "p1 bigint, p2 bigint, sha string")
    rows = nodes.join(digests.hint("shuffle_hash"), P, "left").withColumn("d", F.explode(F.sequence(F.col("up") + 1, F.col("depth")))).drop(*P, "upto")
    rows = trie.at(rows.withColumn("d0", F.greatest(F.col("d") - 1, F.lit(0))), "key", "d0", before="upto")
    last = F.col("d") == F.col("depth")
    return rows.select(
        F.col("key").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(F.col("d") > F.col("up") + 1, F.col("key")).otherwise(F.col("top_key")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"),
        (F.col("saved") - (F.col("n_convs") - 1) * (F.col("before") - F.col("above"))).cast("long").alias("saved_tokens"),
        F.when(last & F.col("sha").isNotNull(), F.col("sha")).otherwise(F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )


def prefix_tree(conversations: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = cut(numbered(conversations))
    turns, ids = rebuilt(rows)
    prefix = cut(prefixes(turns))
    trie = Trie(prefix, ids, batches)
    trie.build()
    out = cut(expanded(trie, cut(summed(trie))))
    trie.paths.unpersist()
    discard(rows, prefix, trie.ends, trie.keys)
    return out
