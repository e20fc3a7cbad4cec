"""Byte-level BPE encoding and decoding by overlapping chunks (operator 3).

A long text is cut into overlapping chunks that are pre-tokenised in parallel. The pattern only looks ahead, so two
scans that share one pre-token boundary agree from there on: where the scan of a chunk (right, if it began at a right
place) and the scan of the next one share a boundary inside the overlap, with no white space before it, the text is stitched. The pieces between the
stitches are whole runs of pre-tokens, so encoding them apart and joining the ids gives the ids of the whole text.
Where a chunk does not resynchronise (one pre-token longer than the overlap), the rest of that text is one piece.
A text of one chunk is one piece. Decoding takes the bytes of each id and concatenates them.

This is done at two sizes. Every text is cut into chunks of SMALL characters, stitched and encoded piece by piece within
its task. Texts of more than `chunk` characters are first cut into chunks of that size, which are scanned and, once
stitched, encoded in different tasks; only their boundaries (a few numbers a chunk) meet in a window.

Defined results: null and empty texts have no ids and no bytes; repeated rows are encoded each for itself; an empty
table gives an empty result; encode() keeps the columns named in `keep`.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, whole_text

#: Texts whose ids a Python worker holds at once.
ROWS_AT_ONCE = 500
#: Characters of a chunk, and of its overlap with the next one, within a task.
SMALL, SMALL_OVERLAP = 2_048, 256
#: Characters at a chunk's end whose pre-tokens what follows may still change.
UNSURE = 4
_loaded: dict[tuple, object] = {}


def _ranks(path: str) -> dict[bytes, int]:
    if ("ranks", path) not in _loaded:
        with open(path, "rb") as f:
            _loaded["ranks", path] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return _loaded["ranks", path]


def _coder(path: str, pattern: str):
    if ("coder", path, pattern) not in _loaded:
        import tiktoken

        _loaded["coder", path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})
    return _loaded["coder", path, pattern]


def _vocabulary(path: str) -> pa.Array:
    """Bytes of every id (null where the file has none)."""
    if ("bytes", path) not in _loaded:
        ranks = _ranks(path)
        table: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            table[i] = token
        _loaded["bytes", path] = pa.array(table, pa.large_binary())
    return _loaded["bytes", path]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays).astype(np.int32) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values))


def _bytes_of(ids: pa.ListArray, vocabulary: pa.Array) -> pa.BinaryArray:
    """Each list's ids as bytes: one take of the vocabulary, cut at the lists' borders."""
    at = np.concatenate([[0], np.cumsum(np.asarray(ids.value_lengths().fill_null(0)))]).astype(np.int64)
    joined = vocabulary.take(ids.flatten())
    if joined.null_count:
        raise ValueError("an id is not in the vocabulary")
    _, offsets, data = joined.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1] if len(joined) else np.zeros(1, np.int64)
    borders = pa.py_buffer(np.ascontiguousarray(ends[at]))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, borders, data or pa.py_buffer(b"")]).cast(pa.binary())


def scan(text: str, s: int, chunk: int, overlap: int, compiled) -> tuple[list[int], list[int]]:
    """Pre-token boundaries of the chunk at s that lie in its overlap with the chunk before and with the next one.

    A boundary after white space does not count: how a run of it is split depends on whether more follows, so a piece
    that ends there would be split otherwise than the text.
    """
    body = text[s : s + chunk + overlap]
    last = s + chunk >= len(text)
    ends = [b for b in [s, *(s + m.end() for m in compiled.finditer(body))] if not text[b - 1 : b].isspace()]
    sure = s + len(body) - UNSURE
    head = [b for b in ends if b < s + overlap and (last or b <= sure)]
    tail = [] if last else [b for b in ends if s + chunk <= b <= sure]
    return head, tail


def stitched(text: str, compiled, chunk: int, overlap: int) -> list[str]:
    """The pieces of a text between its stitches; where two chunks share no boundary, all that follows is one piece."""
    out, begin, before = [], 0, None
    for s in range(0, len(text), chunk):
        head, tail = scan(text, s, chunk, overlap, compiled) if len(text) > chunk else ([], [])
        if before is not None:
            shared = before.intersection(head)
            if not shared:
                break
            out.append(text[begin : (begin := min(shared))])
        before = set(tail)
    return [*out, text[begin:]]


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, decoded: bool) -> Iterator[pa.RecordBatch]:
    import regex

    coder, vocabulary, compiled = _coder(path, pattern), _vocabulary(path), regex.compile(pattern)

    def ids_of(text: str) -> np.ndarray:
        pieces = [coder.encode_to_numpy(p, disallowed_special=()) for p in stitched(text, compiled, SMALL, SMALL_OVERLAP)]
        return pieces[0] if len(pieces) == 1 else np.concatenate(pieces)

    for batch in batches:
        for begin in range(0, len(batch), ROWS_AT_ONCE):
            part = batch.slice(begin, ROWS_AT_ONCE)
            ids = _lists([ids_of(t) for t in part.column("_t").to_pylist()])
            kept = [c for c in part.schema.names if c != "_t"]
            more = [ids, _bytes_of(ids, vocabulary)] if decoded else [ids]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *more], [*kept, "ids", "bytes"][: len(kept) + len(more)])


def _scanned(batches: Iterator[pa.RecordBatch], pattern: str, chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Long texts -> chunks with the pre-token boundaries that lie in their head and tail overlaps (positions in the text)."""
    import regex

    compiled = regex.compile(pattern)
    for batch in batches:
        for r in range(len(batch)):
            text, row = batch.column("_t")[r].as_py(), batch.slice(r, 1)
            for k, s in enumerate(range(0, len(text), chunk)):
                head, tail = scan(text, s, chunk, overlap, compiled)
                kept = [row.column(c) for c in row.schema.names if c != "_t"]
                body = text[s : s + chunk + overlap]
                more = [pa.array([k]), pa.array([s]), pa.array([s + chunk >= len(text)]), pa.array([body]), pa.array([head], pa.list_(pa.int64())), pa.array([tail], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*kept, *more], [*(c for c in row.schema.names if c != "_t"), "k", "s", "last", "body", "head", "tail"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocabulary = _vocabulary(path)
    for whole in batches:
        for begin in range(0, len(whole), ROWS_AT_ONCE):
            batch = whole.slice(begin, ROWS_AT_ONCE)
            kept = [c for c in batch.schema.names if c != "ids"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _bytes_of(batch.column("ids"), vocabulary)], [*kept, "bytes"])


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), chunk: int = 32_768, overlap: int = 2_048, decoded: bool = False) -> DataFrame:
    """The `keep` columns of every row and `ids`, those of the whole text.

    decoded adds `bytes`, what decode() gives for the ids, made by the same Python workers.
    """
    kinds = dict(docs.dtypes)
    kept = ", ".join(f"`{c}` {kinds[c]}" for c in keep)
    rows = small_batches(docs).select(*keep, whole_text().alias("_t"))
    run = lambda batches: _encoded(batches, path, pattern, decoded)
    made = "ids array<int>, bytes binary" if decoded else "ids array<int>"
    short = rows.where(F.length("_t") <= chunk).mapInArrow(run, f"{kept}, {made}")

    long = rows.where(F.length("_t") > chunk).withColumn("rid", F.monotonically_increasing_id())
    chunks = cut(long.mapInArrow(lambda b: _scanned(b, pattern, chunk, overlap), f"{kept}, rid bigint, k bigint, s bigint, last boolean, body string, head array<bigint>, tail array<bigint>"))
    order = Window.partitionBy("rid").orderBy("k")
    cuts = chunks.select("rid", "k", "last", "head", "tail").withColumn("next", F.when(~F.col("last"), F.array_min(F.array_intersect("tail", F.lead("head").over(order)))))
    lost = F.coalesce(F.max((F.col("next").isNull() & ~F.col("last")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    cuts = cuts.withColumn("lost", lost).withColumn("begin", F.coalesce(F.lag("next").over(order), F.lit(0)))
    # a piece: one chunk between its stitches, or from the last right stitch all that follows
    cuts = cuts.withColumn("piece", F.when(~F.col("lost"), F.col("k"))).withColumn("piece", F.last("piece", ignorenulls=True).over(order))
    cuts = cuts.withColumn("open", F.col("next").isNull() & ~F.col("last")).select("rid", "k", "piece", "begin", "next", "lost", "open")
    placed = chunks.drop("head", "tail").join(cuts, ["rid", "k"])
    whole = placed.where(~F.col("lost") & ~F.col("open"))
    first = F.col("begin") - F.col("s")
    size = F.coalesce(F.col("next") - F.col("begin"), F.lit(1 << 30)).cast("int")
    direct = whole.select(*keep, "rid", "piece", F.substring(F.col("body"), (first + 1).cast("int"), size).alias("_t"))
    rest = placed.where(F.col("lost") | F.col("open")).withColumn("part", F.substring(F.col("body"), F.when(F.col("lost"), F.lit(1)).otherwise(first + 1).cast("int"), F.when(F.col("last"), F.lit(1 << 30)).when(F.col("lost"), F.lit(chunk)).otherwise(F.lit(chunk) - first).cast("int")))
    merged = rest.groupBy("rid", "piece").agg(*[F.first(c).alias(c) for c in keep], F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "").alias("_t"))
    pieces = direct.unionByName(merged.select(*keep, "rid", "piece", "_t"))
    coded = pieces.mapInArrow(run, f"{kept}, rid bigint, piece bigint, {made}")
    in_order = lambda value: F.array_sort(F.collect_list(F.struct("piece", value.alias("v"))))
    whole_ids = F.flatten(F.transform(in_order(F.col("ids")), lambda x: x["v"])).alias("ids")
    whole_bytes = [F.unhex(F.array_join(F.transform(in_order(F.hex("bytes")), lambda x: x["v"]), "")).alias("bytes")] if decoded else []
    joined = coded.groupBy("rid").agg(*[F.first(c).alias(c) for c in keep], whole_ids, *whole_bytes)
    return short.unionByName(joined.drop("rid"))


def decode(coded: DataFrame, path: str) -> DataFrame:
    """coded with `ids` replaced by `bytes`: the concatenation of each id's raw bytes. Other columns stay."""
    kept = ", ".join(f"`{c}` {k}" for c, k in coded.dtypes if c != "ids")
    return coded.mapInArrow(lambda batches: _decoded(batches, path), f"{kept}, bytes binary" if kept else "bytes binary")
