"""Token ids in a compressed binary format, written in document order and read back (operator 10).

Documents are dealt to ranges of doc_id and sorted within them. Each task tokenises its documents and packs their ids,
one after another, into blocks of up to BLOCK ids that the context-mixing range coder codes independently (mixcoder). A
file is a Parquet part of such blocks: Spark's committer makes it whole or absent, whatever happens to executors, and any
store that Spark writes will do. A block's row holds the coded bytes, with their own checksum, and the list of document
segments in it; so every row can be decoded alone, and only a document that crosses a border needs two.

The tokenizer is asked once for each distinct word of a worker (white space always ends a token, and is dropped), and
once for the signs behind words, which gives the ids of the whole text. Its special tokens keep their ids inside a text,
as the library has it by default.

Defined results: null and empty texts have only the end id; documents with null doc_id come first; repeated rows and
rows of one doc_id are written each for itself, in the order of their texts' hashes; a text of any length runs over as
many blocks as it needs; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches, whole_text
from .mixcoder import decode_blocks, encode_blocks, bits_for
from .shingles import pieces, text_bytes, word_hashes, words

#: Letters that case and normal forms turn into letters, and one sign that stands apart.
PLAIN_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+([.,;:!?]?)")
#: Letters that are one pre-token and, A-Z lower-cased, their own normal form.
STABLE_WORD = re.compile("[A-Za-z\u00df-\u00f6\u00f8-\u00ff]+")
#: Most ids of a block: the model learns from all of them, and a task holds a few arrays of so many.
BLOCK = 1 << 21
#: Blocks that a task holds at once.
TOGETHER = 1
#: Bytes of a row group: a reader holds one of them.
ROW_GROUP = 32 << 20
_loaded: dict[str, object] = {}


class _Words:
    """Ids of words, each asked of the tokenizer once; forgotten when there are too many.

    Words are known by their hashes, which are kept in a table with open addresses: the slot of a word's hash gives its
    number, and all words' ids stand one after another.
    """

    def __init__(self, path: str, most: int = 1_500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model without the steps before it that leave a STABLE_WORD as it is
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.most = most
        self.largest = self.tokenizer.get_vocab_size(with_added_tokens=True) - 1
        self.closes = np.zeros(self.largest + 1, bool)  # ids at the end of a pre-token
        self.closes[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.n, self.held = 0, 0
        self.upto, self.flat = np.zeros(1 << 12, np.int64), np.empty(1 << 14, np.uint32)  # word k's ids: upto[k] to upto[k + 1]
        self.known = np.empty(1 << 12, np.uint64)
        self._clear(14)

    def _clear(self, bits: int) -> None:
        self.bits, self.slots, self.number = bits, np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The words' numbers; -1 of unknown ones."""
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.intp)
        out = self.number.take(slot)
        rest = np.flatnonzero((self.slots.take(slot) != hashes) & (out >= 0))  # taken by another word
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & (len(self.slots) - 1)
            out[rest] = self.number.take(slot)
            going = (self.slots.take(slot) != hashes[rest]) & (out[rest] >= 0)
            rest, slot = rest[going], slot[going]
        return out

    def _put(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.intp)
        while len(slot):
            free = self.number.take(slot) < 0
            self.slots[slot[free]], self.number[slot[free]] = hashes[free], numbers[free]
            left = self.number.take(slot) != numbers
            hashes, numbers, slot = hashes[left], numbers[left], (slot[left] + 1) & (len(self.slots) - 1)

    def _add(self, hashes: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        """New, distinct words with their ids."""
        def grown(old: np.ndarray, used: int, more: int) -> np.ndarray:
            return old if used + more <= len(old) else np.concatenate([old[:used], np.zeros(more + used // 2, old.dtype)])

        n = self.n + len(hashes)
        self.upto, self.known, self.flat = grown(self.upto, self.n + 1, len(hashes)), grown(self.known, self.n, len(hashes)), grown(self.flat, self.held, len(flat))
        self.upto[self.n + 1 : n + 1] = self.held + np.cumsum(sizes)
        self.known[self.n : n] = hashes
        self.flat[self.held : self.held + len(flat)] = flat
        before, self.n, self.held = self.n, n, self.held + len(flat)
        if 2 * n > len(self.slots):
            self._clear((2 * n).bit_length())
            before = 0
        self._put(self.known[before:n], np.arange(before, n, dtype=np.int32))

    def _out(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these words, one after another, and the n + 1 offsets."""
        begin, end = self.upto.take(numbers), self.upto.take(numbers + 1)
        end -= begin
        upto = np.concatenate([[0], np.cumsum(end)])
        begin -= upto[:-1]
        place = np.repeat(begin, end)
        place += np.arange(len(place))
        return self.flat.take(place), upto

    def _asked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has.

        Words of letters, with one stop or comma at most, have one or two pre-tokens: they are asked together, and cut
        where their pre-tokens end. All others are asked one by one.
        """
        plain = [PLAIN_WORD.fullmatch(w) for w in words]
        stable = [bool(STABLE_WORD.fullmatch(w)) for w in words]
        bare = [i for i, x in enumerate(stable) if x]
        easy = [i for i, m in enumerate(plain) if m and not stable[i]]
        hard = [i for i, m in enumerate(plain) if not m]
        parts, sizes, order = [], [], []
        for tokenizer, those in ((self.bare, bare), (self.tokenizer, easy)):
            some = [those[k : k + 25] for k in range(0, len(those), 25)]
            for begin in range(0, len(some), 100):
                joined = [" ".join(words[i] for i in g) for g in some[begin : begin + 100]]
                if tokenizer is self.bare:
                    joined = [x.lower() for x in joined]
                for group, got in zip(some[begin : begin + 100], tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
                    ids = np.array(got.ids, dtype=np.uint32)
                    ends = np.flatnonzero(self.closes[ids]) + 1
                    upto = np.cumsum([2 if plain[i].end(1) > plain[i].start(1) else 1 for i in group])
                    if len(ends) != upto[-1]:
                        hard += group
                        continue
                    parts.append(ids)
                    sizes.append(np.diff(ends[upto - 1], prepend=0))
                    order += group
        alone = [e.ids for e in self.tokenizer.encode_batch_fast([words[i] for i in hard], add_special_tokens=False)]
        parts += [np.array(ids, dtype=np.uint32) for ids in alone]
        sizes.append(np.array([len(ids) for ids in alone], dtype=np.int64))
        back = np.argsort(order + hard)  # of each word among those asked
        size = np.concatenate(sizes)
        begin = (np.cumsum(size) - size)[back]
        size = size[back]
        flat = np.concatenate(parts) if parts else self.flat[:0]
        return flat[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(len(flat))], size

    def _learn(self, body: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray, whole: np.ndarray) -> None:
        """Ask for new, distinct words. Signs behind a last letter or digit are pre-tokens of their own: unless the word
        is to stay whole, it has the ids of what stands before them, and theirs."""
        size = end - start
        upto = np.concatenate([[0], np.cumsum(size)])
        body = body[np.repeat(start - upto[:-1], size) + np.arange(upto[-1])]  # of these words alone
        start, end = upto[:-1], upto[1:]
        cut = end - _signs(body, start, end)
        split = (cut < end) & ~whole
        more = [(start[split], cut[split]), (cut[split], end[split])]
        parts = [word_hashes(body, a, b) for a, b in more]
        a, b, own = (np.concatenate(x) for x in ((start[~split], *(m[0] for m in more)), (end[~split], *(m[1] for m in more)), (hashes[~split], *parts)))
        own, sample = np.unique(own, return_index=True)
        new = self._find(own) < 0
        if new.any():
            self._add(own[new], *self._asked([body[a[i] : b[i]].tobytes().decode() for i in sample[new].tolist()]))
        late = np.flatnonzero(self._find(hashes) < 0)
        if len(late):  # those that were split
            at = (np.cumsum(split) - 1)[late]
            flat, offsets = self._out(np.stack([self._find(parts[0][at]), self._find(parts[1][at])], axis=1).reshape(-1))
            self._add(hashes[late], flat, np.diff(offsets[::2]))

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, one after another, and the n + 1 offsets."""
        body, at = text_bytes(texts)
        start, end, first = words(body, at)
        if not len(start):
            return np.empty(0, np.uint32), np.zeros(len(at), np.int64)
        hashes = word_hashes(body, start, end)  # the tokenizer lower-cases all but its special tokens, "<|...|>"
        whole = np.zeros(len(start), bool)
        marked = np.flatnonzero((body[:-1] == ord("<")) & (body[1:] == ord("|")))
        if len(marked):
            own = np.unique(np.searchsorted(start, marked, "right") - 1)
            hashes[own] = word_hashes(body, start[own], end[own], lower=False) ^ np.uint64(1)
            whole[own] = True
        if self.n > self.most:
            self.forget()
        numbers = self._find(hashes)
        missing = np.flatnonzero(numbers < 0)
        if len(missing):
            new = missing[np.unique(hashes[missing], return_index=True)[1]]
            self._learn(body, start[new], end[new], hashes[new], whole[new])
            numbers[missing] = self._find(hashes[missing])
        flat, upto = self._out(numbers)
        return flat, upto[first]


#: By byte: ASCII signs; letters and digits of one byte; last bytes of the letters from \u00c0 to \u00ff, behind 0xC3.
_BYTE = np.arange(256)
_SIGN = np.isin(_BYTE, [b for b in range(0x21, 0x7F) if not chr(b).isalnum()])
_PLAIN_END = np.isin(_BYTE, [b for b in range(0x21, 0x7F) if chr(b).isalnum()])
_C3_END = (_BYTE >= 0x80) & (_BYTE < 0xC0) & (_BYTE != 0x97) & (_BYTE != 0xB7)
#: Words that more signs end are asked whole.
MOST_SIGNS = 16


def _signs(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many ASCII signs end each word behind a letter or digit; 0 if something else or too many of them do."""
    n = np.zeros(len(start), np.int64)
    going = np.arange(len(start))
    for _ in range(MOST_SIGNS):
        at = end[going] - 1 - n[going]
        going = going[(at > start[going]) & _SIGN[body[at]]]
        n[going] += 1
    n[going] = 0
    last = end - n - 1
    letter = _PLAIN_END[body[last]] | ((last > start) & (body[last - 1] == 0xC3) & _C3_END[body[last]])
    return np.where(letter, n, 0)


def _words(path: str) -> _Words:
    if path not in _loaded:
        _loaded[path] = _Words(path)
    return _loaded[path]


BLOCK_ROW = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int64()),
        ("n_ids", pa.int64()),
        ("payload", pa.binary()),
        ("segments", pa.list_(pa.struct([("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("first", pa.bool_()), ("last", pa.bool_())]))),
    ]
)
BLOCK_SCHEMA = "part int, block bigint, n_ids bigint, payload binary, segments array<struct<doc_id: bigint, row: bigint, at: bigint, n: bigint, first: boolean, last: boolean>>"


#: Blocks of one output batch.
ROWS_OUT = 256


def _segments(upto: np.ndarray, full: int, begun: bool) -> tuple[np.ndarray, ...]:
    """The first `full` ids, cut at the borders of blocks and documents: (document, start, n, first, last, n + 1 places of each block's segments).

    upto: the n + 1 offsets of the documents, none of which is empty; begun: the first one has ids in earlier blocks.
    """
    starts = np.union1d(upto[:-1][upto[:-1] < full], np.arange(0, full, BLOCK))
    ends = np.append(starts[1:], full)
    doc = np.searchsorted(upto, starts, "right") - 1
    first = (starts == upto[doc]) & ~((doc == 0) & begun)
    return doc, starts, ends - starts, first, ends == upto[doc + 1], np.searchsorted(starts, np.append(np.arange(0, full, BLOCK), full))


class _Part:
    """Ids of a part's documents that are not in blocks yet."""

    def __init__(self, part: int) -> None:
        self.part, self.block, self.row, self.at = part, 0, 0, 0  # row: of the first document held; at: of the first id
        self.ids: list[np.ndarray] = []
        self.names: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.held, self.begun = 0, False

    def add(self, ids: np.ndarray, names: pa.Array, sizes: np.ndarray) -> None:
        self.ids.append(ids)
        self.names.append(names)
        self.sizes.append(sizes)
        self.held += len(ids)

    def blocks(self, bits: int, last: bool) -> Iterator[pa.RecordBatch]:
        """All full blocks, and if last the rest."""
        if not self.held:
            return
        stream, names, sizes = np.concatenate(self.ids), pa.concat_arrays(self.names), np.concatenate(self.sizes)
        upto = np.concatenate([[0], np.cumsum(sizes)])
        full = len(stream) if last else len(stream) // BLOCK * BLOCK
        begun, row, at, block = self.begun, self.row, self.at, self.block
        d = int(np.searchsorted(upto, full, "right")) - 1  # the first document with ids left
        left = full < len(stream)
        self.begun, self.row, self.at, self.block = left and (full > upto[d] or (d == 0 and begun)), row + d, at + full, block + -(-full // BLOCK)
        self.held = len(stream) - full
        self.ids = [stream[full:].copy()] if left else []
        self.names, self.sizes = ([names[d:]], [np.append(upto[d + 1] - full, sizes[d + 1 :])]) if left else ([], [])

        doc, start, n, first, ends, places = _segments(upto, full, begun)
        cuts = np.arange(0, full, BLOCK)
        codes = encode_blocks([stream[c : min(c + BLOCK, full)] for c in cuts.tolist()], bits)
        del stream
        for lo in range(0, len(cuts), ROWS_OUT):
            hi = min(lo + ROWS_OUT, len(cuts))
            x = slice(places[lo], places[hi])
            fields = [names.take(pa.array(doc[x])), pa.array(row + doc[x]), pa.array(at + start[x]), pa.array(n[x]), pa.array(first[x]), pa.array(ends[x])]
            struct = pa.StructArray.from_arrays(fields, fields=list(BLOCK_ROW.field("segments").type.value_type))
            segments = pa.ListArray.from_arrays(pa.array((places[lo : hi + 1] - places[lo]).astype(np.int32)), struct)
            sizes_out = np.minimum(cuts[lo:hi] + BLOCK, full) - cuts[lo:hi]
            columns = [pa.array(np.full(hi - lo, self.part, np.int32)), pa.array(block + np.arange(lo, hi)), pa.array(sizes_out), pa.array(codes[lo:hi], pa.binary()), segments]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, BLOCK_ROW)], schema=BLOCK_ROW)


def _written(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    """Sorted documents of whole parts -> block rows."""
    tokens = _words(path)
    bits = bits_for(max(tokens.largest, end_id))
    held: _Part | None = None
    for batch in batches:
        for begin, end in pieces(batch.column("_t")):
            piece = batch.slice(begin, end - begin)
            flat, offsets = tokens.ids(piece.column("_t"))
            flat = np.insert(flat, offsets[1:], np.uint32(end_id))
            offsets = offsets + np.arange(len(offsets))
            parts, names = np.asarray(piece.column("part")), piece.column("doc_id").cast(pa.int64())
            edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(piece)]
            for a, b in zip(edges[:-1], edges[1:]):
                if held is None or held.part != parts[a]:
                    if held is not None:
                        yield from held.blocks(bits, True)
                    held = _Part(int(parts[a]))
                held.add(flat[offsets[a] : offsets[b]], names.slice(a, b - a), np.diff(offsets[a : b + 1]))
            if held is not None and held.held >= TOGETHER * BLOCK:
                yield from held.blocks(bits, False)
    if held is not None:
        yield from held.blocks(bits, True)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, rows_per_part: int = 16_384) -> None:
    """Files of ids under path, parts in ascending order of doc_id."""
    n = max(1, docs.count())
    parts = max(2, -(-n // rows_per_part))
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("_t"))
    dealt = rows.repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()).withColumn("_h", F.xxhash64("_t"))
    ordered = dealt.sortWithinPartitions("doc_id", "_h").select("doc_id", "part", "_t")
    writer = ordered.mapInArrow(lambda b: _written(b, tokenizer, end_id), BLOCK_SCHEMA).write.option("parquet.block.size", ROW_GROUP)
    for what in ("page", "block"):  # rows are large: look at the size behind each, not behind 100
        writer = writer.option(f"parquet.{what}.size.row.check.min", 1).option(f"parquet.{what}.size.row.check.max", 1)
    writer.parquet(path)


class _Joiner:
    """Documents out of segments in order: those that begin and end here as one row, the rest as pieces of raw ids."""

    def __init__(self) -> None:
        self.out: list[tuple] = []
        self.open: list[tuple] = []  # (part, segment, raw ids) of a document that has begun here

    def give_up(self) -> None:
        self.out += [(part, s["row"], s["doc_id"], s["at"], s["n"], None, piece) for part, s, piece in self.open]
        self.open = []

    def add(self, part: int, s: dict, piece: bytes) -> None:
        if self.open:
            before_part, before, _ = self.open[-1]
            if s["first"] or (before_part, before["row"], before["at"] + before["n"]) != (part, s["row"], s["at"]):
                self.give_up()
        if not s["first"] and not self.open:
            self.out.append((part, s["row"], s["doc_id"], s["at"], s["n"], None, piece))
            return
        self.open.append((part, s, piece))
        if s["last"]:
            crc = 0
            for _, _, x in self.open:
                crc = zlib.crc32(x, crc)
            self.out.append((part, s["row"], s["doc_id"], self.open[0][1]["at"], sum(x["n"] for _, x, _ in self.open), crc, None))
            self.open = []

    def rows(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) if self.out else [[]] * 7
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["part", "row", "doc_id", "at", "n", "crc", "piece"])


def _joined(some: pa.RecordBatch, ids: list[np.ndarray], joiner: _Joiner) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Documents that begin and end in these blocks, as rows; segments of others go to the joiner, in order."""
    stream = np.concatenate(ids).astype("<u4", copy=False) if ids else np.empty(0, "<u4")
    lists = some.column("segments")
    flat = lists.flatten()
    part = np.repeat(np.asarray(some.column("part")), np.asarray(lists.value_lengths().fill_null(0)))
    row, at, n, first, last = (np.asarray(flat.field(c)) for c in ("row", "at", "n", "first", "last"))
    names = flat.field("doc_id")
    ends = np.cumsum(n)
    begins = ends - n  # a block's segments hold all its ids in order
    new = np.ones(len(n), bool)
    new[1:] = first[1:] | (part[1:] != part[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + n[:-1])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(n))[: len(head)] - 1
    whole = first[head] & last[tail]
    raw = memoryview(stream).cast("B")
    for a, b in zip(head[~whole].tolist(), tail[~whole].tolist()):
        for k in range(a, b + 1):
            s = {"doc_id": names[k].as_py(), "row": int(row[k]), "at": int(at[k]), "n": int(n[k]), "first": bool(first[k]), "last": bool(last[k])}
            joiner.add(int(part[k]), s, bytes(raw[4 * int(begins[k]) : 4 * int(ends[k])]))
    head, tail = head[whole], tail[whole]
    crc = np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins[head].tolist(), ends[tail].tolist())], np.int64)
    columns = [part[head], row[head], names.take(pa.array(head)), at[head], ends[tail] - begins[head], crc, pa.nulls(len(head), pa.binary())]
    rows = joiner.rows()
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], rows.schema.names), rows


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    joiner = _Joiner()
    for batch in batches:
        for begin in range(0, len(batch), TOGETHER):
            some = batch.slice(begin, TOGETHER)
            yield from _joined(some, decode_blocks(some.column("payload").to_pylist()), joiner)
    joiner.give_up()
    yield joiner.rows()


def read(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    segments = files.mapInArrow(_read, "part int, row bigint, doc_id bigint, at bigint, n bigint, crc bigint, piece binary")
    segments = cut(segments)
    whole = segments.where("crc is not null").select("part", "doc_id", "at", "n", "crc")
    joined = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.hex("piece").alias("piece")))), lambda x: x["piece"]), ""))
    split = segments.where("crc is null").groupBy("part", "row").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n"), F.crc32(joined).alias("crc")).select("part", "doc_id", "at", "n", "crc")
    # one row a part: as many as the writer had tasks
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = totals.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return whole.unionByName(split).join(before, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
