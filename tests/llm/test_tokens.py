"""BPE and token files: exact round trips against the tokenizer libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelkit.llm import bpe, mixcoder, queries, tokenfile

from .conftest import MESSY, SF

RANKS, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
CODER = bpe._coder(RANKS, public_tokenizers.PATTERN)


def digest(data):
    return hashlib.sha256(data).hexdigest()


def test_bpe_equals_library(spark, documents):
    texts = dict(documents)
    got = queries.op3_byte_bpe(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = CODER.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids)).encode()), digest(texts[r.doc_id].encode()))


def test_stitched_chunks_equal_whole_texts(spark):
    rnd = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "'", "s", "'re", "a", "Z", "é", "ß", "1", "23", "!", "..", "日本", "🙂", "　", "x" * 30, " " * 40, "́", "Ǆ"]
    texts = {i: "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 300))) for i in range(120)}
    texts |= {1000: "a" * 5000, 1001: " " * 3000 + "b", 1002: None, 1003: "", 1004: ("ab " * 20 + "q" * 300) * 10}
    rows = spark.createDataFrame(list(texts.items()), "doc_id int, text string").repartition(3)
    got = bpe.encode(rows, RANKS, public_tokenizers.PATTERN, chunk=64, overlap=16, decoded=True).collect()
    assert {r.doc_id: bytes(r["bytes"]) for r in got} == {i: (t or "").encode() for i, t in texts.items()}
    assert {r.doc_id: r.ids for r in got} == {i: CODER.encode_ordinary(t or "") for i, t in texts.items()}


def test_stitched_pieces_are_whole_pretokens():
    """Random texts in small chunks: the pieces' pre-tokens are those of the text, and most texts are cut."""
    import random

    import regex

    compiled = regex.compile(public_tokenizers.PATTERN)
    rng = random.Random(3)
    alphabet = ["a", "Z", "ß", "日", "9", "0", " ", "  ", "\n", "\t", "'s", "'re", "!", "...", "🙂", "é", "\u0301", "x" * 30]
    many = 0
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 300)))
        pieces = bpe.stitched(text, compiled, 32, 16)
        assert "".join(pieces) == text
        assert [m for p in pieces for m in compiled.findall(p)] == compiled.findall(text)
        many += len(pieces) > 2
    assert many > 100
    assert bpe.stitched("", compiled, 32, 16) == [""] and bpe.stitched("a" * 500, compiled, 32, 16) == ["a" * 500]


def test_no_stitch_behind_white_space(spark):
    """A run of white space before a sign is split by what follows it: a piece must not end there."""
    texts = [(i, ("word " * i + "   \t🙂! \n\n  x" + " " * (i % 7) + "\t?") * 12) for i in range(40)]
    got = bpe.encode(spark.createDataFrame(texts, "doc_id int, text string"), RANKS, public_tokenizers.PATTERN, chunk=48, overlap=16).collect()
    want = {i: CODER.encode_ordinary(t) for i, t in texts}
    assert len(got) == 40 and all(list(r.ids) == want[r.doc_id] for r in got)


def test_ordinary_texts_are_stitched(documents):
    import regex

    compiled = regex.compile(public_tokenizers.PATTERN)
    cut = [t for _, t in documents if len(bpe.stitched(t, compiled, bpe.SMALL, bpe.SMALL_OVERLAP)) > 1]
    assert len(cut) > len(documents) / 10


def test_bpe_edge_cases(messy, nothing):
    coded = bpe.encode(messy.drop("ids"), RANKS, public_tokenizers.PATTERN, keep=("doc_id", "size"))
    got = bpe.decode(coded, RANKS).collect()
    assert sorted(bytes(r["bytes"]) for r in got) == sorted((t or "").encode() for _, t, _ in MESSY)
    assert bpe.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(Exception):
        bpe.decode(coded.withColumn("ids", F.array(F.lit(10_000_000))), RANKS).count()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 65_535) | st.integers(0, 4), max_size=60), max_size=6))
def test_range_coder_round_trip(blocks):
    arrays = [np.array(b, dtype=np.uint32) for b in blocks]
    back = mixcoder.decode_blocks(mixcoder.encode_blocks(arrays, 16, lanes=4), lanes=3)
    assert [b.tolist() for b in back] == blocks


def test_range_coder_compresses_and_checks(documents):
    ids = np.tile(np.random.RandomState(0).randint(0, 49_000, 200), 20).astype(np.uint32)
    code = mixcoder.encode_blocks([ids], 16)[0]
    assert len(code) < len(ids) and mixcoder.decode_blocks([code])[0].tolist() == ids.tolist()
    for at in (5, 30, len(code) // 2):
        with pytest.raises(ValueError):
            mixcoder.decode_blocks([code[:at] + bytes([code[at] ^ 64]) + code[at + 1 :]])
    big = np.array([0, 1 << 20, (1 << 32) - 1], dtype=np.uint32)
    assert mixcoder.decode_blocks(mixcoder.encode_blocks([big], 32))[0].tolist() == big.tolist()


def test_every_digit_is_modelled():
    """Ids that no context predicts cost what their own frequencies say, in all digits."""
    rnd = np.random.RandomState(1)
    few = rnd.randint(0, 49_000, 64).astype(np.uint32)
    ids = few[rnd.randint(0, 64, 4096)]
    assert len(mixcoder.encode_blocks([ids], 16)[0]) < 1.15 * len(ids)  # 0.75 bytes an id at best, 2 uncoded


def expected(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    start, out = 0, []
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files_equal_library(spark, documents):
    got = queries.op10_token_files(spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == expected(sorted(documents))


def test_token_files_edge_cases(spark, messy, nothing, tmp_path):
    odd = [(20 + i, t, "s") for i, t in enumerate(["don't  STOP now", "é É ǅ İ ſ", "a b　c", "it's <|endoftext|> 'll 12345", "a<|endoftext|>b<|startoftext|> <|ENDOFTEXT|> <|EndOfText|>x <|<|endoftext|> end<|", "Foo, foo. FOO; foo! ﬁne Åse áb İx Ĳ, naïve? straße:", "ΑΣ ΑΣ. ẞ\x00\x1c\x85x"])]
    rows = spark.createDataFrame([(i, t) for i, t, _ in odd], "doc_id bigint, text string").unionByName(messy.select("doc_id", "text"))
    tokenfile.write(rows, str(tmp_path / "a"), WORDS, rows_per_part=4)
    got = tokenfile.read(spark.read.schema(tokenfile.BLOCK_SCHEMA).parquet(str(tmp_path / "a"))).collect()
    everything = [(i, t) for i, t, _ in [*MESSY, *odd]]
    pick = lambda rows: sorted((str(r[0]), r[2], r[3]) for r in rows)
    assert pick(got) == pick(expected(everything))
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(x.n_tokens for x in ordered[:k]) for k in range(len(ordered))]
    known = [r.doc_id for r in ordered if r.doc_id is not None]
    assert known == sorted(known)
    tokenfile.write(nothing, str(tmp_path / "b"), WORDS)
    assert tokenfile.read(spark.read.schema(tokenfile.BLOCK_SCHEMA).parquet(str(tmp_path / "b"))).count() == 0


def test_documents_over_a_reader_border_go_as_pieces():
    seg = lambda row, at, n, first, last: {"doc_id": row, "row": row, "at": at, "n": n, "first": first, "last": last}
    joiner = tokenfile._Joiner()
    joiner.add(0, seg(1, 10, 1, False, True), b"tail")  # began in another task
    joiner.add(0, seg(2, 11, 2, True, False), b"one-")
    joiner.add(0, seg(2, 13, 1, False, True), b"two")
    joiner.add(0, seg(3, 14, 1, True, True), b"whole")
    joiner.add(0, seg(4, 15, 1, True, False), b"head")  # ends in another task
    joiner.add(1, seg(0, 0, 1, True, True), b"next part")
    joiner.give_up()
    got = [(r["part"], r["row"], r["at"], r["n"], r["crc"], r["piece"]) for r in joiner.rows().to_pylist()]
    assert got == [(0, 1, 10, 1, None, b"tail"), (0, 2, 11, 3, zlib.crc32(b"one-two"), None), (0, 3, 14, 1, zlib.crc32(b"whole"), None), (0, 4, 15, 1, None, b"head"), (1, 0, 0, 1, zlib.crc32(b"next part"), None)]


def test_short_documents_make_no_python_objects(monkeypatch):
    """Many segments a block are written and read as arrays: memory stays near that of their columns."""
    import tracemalloc

    import pyarrow as pa

    n = 40_000
    texts = pa.RecordBatch.from_pydict({"doc_id": pa.array([None, *range(1, n)], pa.int64()), "part": pa.array([0] * n, pa.int32()), "_t": ["a"] * n})
    tokenfile._words(WORDS).ids(pa.array(["a"]))
    monkeypatch.setattr(tokenfile, "TOGETHER", 32)

    def peak(run):
        list(run())
        tracemalloc.start()
        try:
            return list(run()), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    written, most = peak(lambda: tokenfile._written(iter([texts]), WORDS, 2))
    assert most < 14_000_000, most
    read, most = peak(lambda: tokenfile._read(iter(written)))
    assert most < 14_000_000, most
    rows = [r for b in read for r in b.to_pylist()]
    assert sum(r["crc"] is not None for r in rows) >= n - 2 * len(written) and {r["doc_id"] for r in rows} == {None, *range(1, n)}


def test_segments_over_blocks_batches_and_parts(spark, monkeypatch):
    """Small blocks, written and read in uneven batches: every document comes back with its place, length and digest."""
    import pyarrow as pa

    monkeypatch.setattr(tokenfile, "BLOCK", 16)
    monkeypatch.setattr(tokenfile, "TOGETHER", 4)
    rnd = random.Random(8)
    rows = [(p, None if i == 0 and p == 0 else 1000 * p + i, " ".join(rnd.choice(["a", "bc", "def,"]) for _ in range(rnd.choice([0, 1, 5, 16, 31, 400])))) for p in range(3) for i in range(rnd.randint(1, 60))]
    batches, at = [], 0
    while at < len(rows):
        size = rnd.randint(1, 25)
        part, doc, text = zip(*rows[at : at + size])
        batches.append(pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "part": pa.array(part, pa.int32()), "_t": list(text)}))
        at += size
    written = pa.Table.from_batches(list(tokenfile._written(iter(batches), WORDS, 2))).combine_chunks()
    blocks = written.to_pylist()
    assert all(b["n_ids"] == sum(s["n"] for s in b["segments"]) <= 16 for b in blocks)
    assert [(b["part"], b["block"]) for b in blocks] == [(p, k) for p in range(3) for k in range(sum(b["part"] == p for b in blocks))]
    for size in (1, 3, 9, 1000):
        pieces = {}
        for b in tokenfile._read(iter(written.to_batches(max_chunksize=size))):
            for r in b.to_pylist():
                pieces.setdefault((r["part"], r["row"]), []).append(r)
        for p in range(3):
            own = [(d, t) for q, d, t in rows if q == p]
            for k, (doc, start, n, crc) in enumerate(expected(own)):
                got = sorted(pieces[p, k], key=lambda r: r["at"])
                assert (got[0]["doc_id"], got[0]["at"], sum(r["n"] for r in got)) == (doc, start, n)
                assert (got[0]["crc"] if len(got) == 1 and got[0]["crc"] is not None else zlib.crc32(b"".join(r["piece"] for r in got))) == crc
            assert sum(q == p for q, _ in pieces) == len(own)


def test_signs_behind_words_are_asked_once(monkeypatch):
    """Words that differ in the signs behind them only are one word and some signs to the tokenizer, with the library's ids."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    own, asked = tokenfile._Words(WORDS), []
    ask = own._asked
    monkeypatch.setattr(own, "_asked", lambda words: asked.extend(words) or ask(words))
    stems, signs = ["house", "Äpfel", "naïve", "x9", "don't"], ["", ".", ",", "!!", "###", ".!!", "&&&", "'", "')", "|>"]
    texts = [" ".join(s + e for s in stems) for e in signs]
    library = Tokenizer.from_file(WORDS)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        flat, upto = own.ids(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(upto[:-1], upto[1:])] == want
    assert len(asked) == len(set(asked)) <= len(stems) + len(signs) - 1, asked


def test_odd_words_equal_library():
    """Random words of letters, marks, digits, signs and special tokens; the table of words grows and is forgotten on the way."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    rnd = random.Random(5)
    parts = ["a", "bc", "Z", "É", "é", "ß", "ÿ", "×", "÷", "Ω", "Σ", "İ", "ſ", "…", "—", "́", "̸", "日", "🙂", "1", "23", "'", "'s", "'re", "'LL", ".", ",", "!!", "<", "|", "=", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", " ", "　", "\x00", "@", "_", "-", "#" * 20]
    library, own = Tokenizer.from_file(WORDS), tokenfile._Words(WORDS, most=3000)
    for _ in range(12):
        texts = [" ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(0, 40))) for _ in range(60)]
        flat, upto = own.ids(pa.array(texts))
        for t, a, b in zip(texts, upto[:-1], upto[1:]):
            assert flat[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_lanes_share_what_a_block_learns():
    """Many lanes of one block: the code nears the entropy of ids that no context predicts, and the cost of an id is that of a few numpy steps."""
    import time

    rnd = np.random.RandomState(2)
    weight = 1 / np.arange(1, 5001)
    ids = rnd.choice(rnd.permutation(49_000)[:5000], 600_000, p=weight / weight.sum()).astype(np.uint32)
    entropy = -(weight / weight.sum() * np.log2(weight / weight.sum())).sum() / 8
    begun = time.process_time()
    code = mixcoder.encode_blocks([ids], 16)
    back = mixcoder.decode_blocks(code)
    took = time.process_time() - begun
    assert back[0].tolist() == ids.tolist() and len(code[0]) < 1.06 * entropy * len(ids)
    begun = time.process_time()
    for _ in range(20):
        table = np.sort(ids.astype(np.int64), kind="heapsort")
    assert len(table) == len(ids) and took < time.process_time() - begun, took


@pytest.mark.parametrize("bits, n", [(1, 700), (6, 3000), (17, 5000), (18, 5000), (29, 3000), (32, 5000)])
def test_blocks_of_any_width(bits, n):
    rnd = np.random.RandomState(bits)
    few = rnd.randint(0, 1 << bits, 40, dtype=np.uint64)
    mixed = np.where(rnd.rand(n) < 0.5, few[rnd.randint(0, 40, n)], rnd.randint(0, 1 << bits, n, dtype=np.uint64)).astype(np.uint32)
    for ids in (mixed, mixed[:1], np.full(n, (1 << bits) - 1, np.uint32), np.tile(mixed[:50], n // 50)):
        code = mixcoder.encode_blocks([ids], bits)
        assert mixcoder.decode_blocks(code)[0].tolist() == ids.tolist()
    damaged = bytearray(mixcoder.encode_blocks([mixed], bits)[0])
    for at in range(4, len(damaged), max(1, len(damaged) // 12)):
        damaged[at] ^= 255
        with pytest.raises(ValueError):
            mixcoder.decode_blocks([bytes(damaged)], lanes=64)
        damaged[at] ^= 255
