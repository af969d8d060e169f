import base64
import hashlib
import random
import zlib
from array import array

import numpy as np
import odd
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from textlode.llm import bpe, packing, token_counts
from textlode.llm.pretokens import WORD_PATTERN, is_latin, latin_splitter, splitter, vocabulary

MULTI, BYTE, WORD = (vocabulary(x) for x in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
PATTERN = public_tokenizers.PATTERN


def library(path):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def multi():
    return bpe.Encoder(MULTI, PATTERN), library(MULTI)


def numbers(data: bytes) -> list[int]:
    return array("I", data).tolist()


@pytest.mark.parametrize("text", [x or "" for x in odd.TEXTS] + ["ab" * 3000, " " * 700, "日本" * 500, "x\x1cy\x85z\xa0w"])
def test_ids_are_the_library_s(multi, text):
    own, lib = multi
    assert numbers(own.encode(text)) == lib.encode_ordinary(text)
    assert own.decode(own.encode(text)) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_ids_of_any_text(text):
    own, lib = ANY
    assert numbers(own.encode(text)) == lib.encode_ordinary(text)


ANY = (bpe.Encoder(MULTI, PATTERN, memo=50), library(MULTI))


def test_queue_pops_in_order():
    queue, rng = bpe.RankQueue(), random.Random(3)
    pushed = [(rng.randrange(60_000), rng.randrange(9)) for _ in range(3000)]
    for rank, position in pushed:
        queue.push(rank, position)
    assert [queue.pop() for _ in pushed] == sorted(pushed) and queue.pop() is None


def test_encode_and_decode_tables(spark):
    df = odd.table(spark)
    got = bpe.decode_table(bpe.encode_table(df, MULTI, PATTERN, ids="ids"), MULTI, "ids", "out").collect()
    assert len(got) == df.count() and all(r.out == (r.text or "").encode() and r.key == "k" for r in got)
    assert bpe.encode_table(odd.empty(spark), MULTI, PATTERN).count() == 0
    null = spark.createDataFrame([(None,)], "ids binary")
    assert bpe.decode_table(null, MULTI).first().decoded is None


def test_bpe_shared_queue(multi, monkeypatch):
    """Pre-tokens of several texts are merged together: the ids of the library, and far fewer buckets made than for each alone."""
    own, lib = bpe.Encoder(MULTI, PATTERN, memo=300), multi[1]
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdeortn\u00e9\u4e2d", k=rng.randint(1, 14))) for _ in range(400)) for _ in range(4)] + ["", "a" * 3000, "\u00ff\x00" * 50]
    made, fill = [], bpe.RankQueue.fill
    monkeypatch.setattr(bpe.RankQueue, "fill", lambda self, *x: (made.append(x), fill(self, *x))[1])
    assert [numbers(x) for x in own.encode_all(texts)] == [lib.encode_ordinary(x) for x in texts]
    assert len(made) < 4 * 1600  # each alone fills about one for each pair
    monkeypatch.setattr(bpe, "CHUNK", 1)
    assert [numbers(x) for x in own.encode_all(texts)] == [lib.encode_ordinary(x) for x in texts]


def test_bpe_query(spark, sf_dir, multi):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in bpe.op6_byte_bpe(spark, sf_dir).collect():
        ids = np.array(multi[1].encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_latin_splitter_is_the_general_one():
    rng = random.Random(5)
    for _ in range(2000):
        text = "".join(chr(rng.randrange(256)) for _ in range(40))
        for pattern in (PATTERN, WORD_PATTERN):
            assert is_latin(text) and latin_splitter(pattern).findall(text) == splitter(pattern).findall(text)


def brute_counts(tokens, eos):
    out, start = [], 0
    for i, t in enumerate(tokens):
        if t == eos:
            out.append((start, i - start, True))
            start = i + 1
    return out + ([(start, len(tokens) - start, False)] if start < len(tokens) else [])


@pytest.mark.parametrize("span", [2, 4096])
def test_scan_of_flat_files(spark, tmp_path, monkeypatch, span):
    monkeypatch.setattr(token_counts, "SPAN", span)
    monkeypatch.setattr(token_counts, "RANGE_BLOCKS", 3)
    monkeypatch.setattr(token_counts, "RANGES_PER_TASK", 2)
    rng, eos, expected = random.Random(7), 9, {}
    files = {"a.bin": [rng.randrange(10) for _ in range(997)], "b.bin": [9] * 20, "c.bin": [1] * 50, "d.bin": [], "e.bin": [1] * 64 + [9], "f.bin": [9] + [2] * 63, "g %20ü.bin": [3] * 96}
    for name, tokens in files.items():
        (tmp_path / name).write_bytes(np.array(tokens, "<u2").tobytes())
        expected[name] = [(i, *x) for i, x in enumerate(brute_counts(tokens, eos))]
    blocks = token_counts.read_token_files(spark, str(tmp_path), 2, block_tokens=16)
    got = {name: [] for name in files}
    for r in token_counts.count_tokens(blocks, eos).orderBy("doc_index").collect():
        got[r.file.rsplit("/", 1)[1]].append((r.doc_index, r.first_token, r.n_tokens, r.ended))
    assert got == expected
    assert token_counts.count_tokens(blocks.limit(0), eos).count() == 0


def test_a_flat_file_of_over_two_gigabytes(spark, tmp_path):
    places, size = [5, 1 << 20, (1 << 29) + 77], (1 << 29) + 1000
    with open(tmp_path / "big.bin", "wb") as out:
        for at in places:
            out.seek(4 * at)
            out.write((9).to_bytes(4, "little"))
        out.truncate(4 * size)
    blocks = token_counts.read_token_files(spark, str(tmp_path), 4, block_tokens=1 << 18)
    got = sorted((r.first_token, r.n_tokens, r.ended) for r in token_counts.count_tokens(blocks, 9, 4).collect())
    assert got == [(0, 5, True), (6, (1 << 20) - 6, True), ((1 << 20) + 1, places[2] - (1 << 20) - 1, True), (places[2] + 1, size - places[2] - 1, False)]


def test_written_tables_are_counted(spark):
    df, lib = odd.table(spark).repartition(3), library(BYTE)
    blocks, manifest = token_counts.write_token_blocks(df, "doc_id", "text", BYTE, PATTERN, 50256, block_tokens=64)
    got = token_counts.count_tokens(blocks, 50256).join(manifest, ["file", "doc_index"]).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(((r.doc_id, len(lib.encode_ordinary(r.text or ""))) for r in df.collect()), key=str) and key
    blocks, _ = token_counts.write_token_blocks(odd.empty(spark), "doc_id", "text", BYTE, PATTERN, 50256)
    assert token_counts.count_tokens(blocks, 50256).count() == 0


def test_count_query(spark, sf_dir):
    lib = library(BYTE)
    texts = {r.doc_id: len(lib.encode_ordinary(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.op3_token_counts(spark, sf_dir).collect()} == texts


def words():
    return Tokenizer.from_file(WORD)


def test_word_ids_are_the_library_s():
    tokenizer, own = words(), packing.WordEncoder(WORD, memo=100)
    texts = [x or "" for x in odd.TEXTS] + ["It'S the DON'T' 's ÀÉ µ½²", "ΣΑΣ σας", "é \x1c x"]
    assert [numbers(x) for x in own.encode(texts)] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def check_packing(got, texts, tokenizer, capacity=packing.CAPACITY):
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        rows = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in rows] == [(k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())) for k, s in enumerate(range(0, len(ids), capacity))]
    return len(by_sequence)


def test_packing_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = packing.op7_best_fit_packing(spark, sf_dir).collect()
    assert check_packing(got, texts, words()) <= -(-sum(r.length for r in got) // packing.CAPACITY) + 1


def test_packing_of_odd_tables(spark):
    df = odd.table(spark)
    got = packing.pack_documents(df).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert sum(r.piece == 0 for r in got) == df.count()
    assert packing.pack_documents(odd.empty(spark)).count() == 0


@pytest.mark.parametrize("lengths", [[3000] * 300, list(range(1, 400)), [4096, 1, 4095, 2048, 2048], [7]])
def test_rounds_pack_everything(spark, lengths):
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(lengths)], "i long, length long, offset string")
    got = packing.pack(df, group=40).collect()
    fills = {}
    for r in got:
        fills.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(r.i for r in got) == list(range(len(lengths)))
    for rows in fills.values():
        rows.sort()
        assert [a for a, _ in rows] == [sum(n for _, n in rows[:k]) for k in range(len(rows))] and sum(n for _, n in rows) <= 4096
    if lengths[0] == 1:
        assert len(fills) <= -(-sum(lengths) // 4096) + 2
    with pytest.raises(Exception):
        packing.pack(spark.createDataFrame([(5000,)], "length long")).collect()


def test_best_fit_is_best_fit():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 500)
    bins, offsets, fills = packing.best_fit(lengths, 100)
    rooms = []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= n]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
        else:
            rooms.append(100)
            k = len(rooms) - 1
        rooms[k] -= n
    assert len(fills) == len(rooms) and sorted(100 - fills) == sorted(rooms)
