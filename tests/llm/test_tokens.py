"""Both encoders against their libraries; shard files and packing by exact round trips."""

import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_edges import EDGES
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bitpack, packing, piecebpe
from lodestone.llm.wordbpe import word_bpe


PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(WORDS)
    return lambda t: own.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aabbcdeth ngioTHE  ▁éñ日本😀\n\t01<>_-=*!")), max_size=120))
def test_pieces_equal_the_library(text):
    import sentencepiece

    own = piecebpe.piece_bpe(PIECES)
    lib = test_pieces_equal_the_library.__dict__.setdefault("lib", sentencepiece.SentencePieceProcessor(model_file=PIECES))
    assert own.ids(text) == lib.encode(text) and own.decode(own.ids(text)) == lib.decode(lib.encode(text))


def test_long_words_and_runs(library):
    own = piecebpe.piece_bpe(PIECES)
    for text in ("a" * 4001, " " * 3001, "ab" * 2000, "日" * 300, "the" * 900 + "  the"):
        assert own.ids(text) == library.encode(text)


def test_round_trip_of_edges(edge_docs, no_docs, library):
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in piecebpe.sentencepiece_round_trip(edge_docs).collect())
    want = []
    for i, t in EDGES:
        ids = library.encode(t or "")
        want.append((i or -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    assert piecebpe.sentencepiece_round_trip(no_docs).count() == 0
    assert piecebpe.encode_column(edge_docs).where("doc_id = 6").first().piece_ids == library.encode("a")


def test_word_ids_equal_the_library(words):
    own = word_bpe(WORDS)
    rng = random.Random(3)
    for text in [t or "" for _, t in EDGES] + ["".join(rng.choice("aAbEé ß'sΣς́.,!|12  \x1cﬁİ½日") for _ in range(80)) for _ in range(200)]:
        assert np.frombuffer(own.ids(text.encode()), "<u4").tolist() == words(text)


@pytest.mark.parametrize("bits", [1, 7, 16, 17, 31, 32])
def test_bit_packing(bits):
    for n in (0, 1, 63, 64, 65, 1000):
        ids = np.random.default_rng(n).integers(0, 1 << bits, n, dtype=np.uint64)
        data = bitpack.pack(ids, bits)
        assert len(data) == -(-n // 64) * 8 * bits and (bitpack.unpack(data, bits, n) == ids).all()


def test_shards(edge_docs, no_docs, words, tmp_path):
    folder = f"file://{tmp_path}/ids"
    manifest = bitpack.write_ids(edge_docs, folder, shards=3)
    got = [tuple(r) for r in bitpack.read_ids(edge_docs.sparkSession, manifest).orderBy("start").collect()]
    lists = sorted((i if i is not None else -1, words(t) + [2]) for i, t in EDGES)
    assert [(-1 if g[0] is None else g[0]) for g in got] == [i for i, _ in lists]
    assert sorted((-1 if g[0] is None else g[0], g[2], g[3]) for g in got) == sorted((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in lists)
    assert [g[1] for g in got] == np.cumsum([0] + [g[2] for g in got])[:-1].tolist()
    shard = bitpack.ShardReader(max(manifest, key=lambda m: m["n_ids"])["file"])
    everything = np.concatenate([shard.block_ids(k) for k in range(len(shard.offsets))])
    for lo, hi in ((0, 5), (100, 100), (3, shard.total), (shard.total - 1, shard.total)):
        assert (shard.ids(lo, hi) == everything[lo:hi]).all()
    assert not [p for p in (tmp_path / "ids").iterdir() if p.name.endswith(".tmp")]
    assert bitpack.packed_token_ids(no_docs).count() == 0


def check_pieces(rows, tokens, limits):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for key, start, length, sequence, offset in rows:
        by_doc[key].append((start, length))
        by_sequence[sequence].append((offset, length))
    for key, n in tokens.items():
        at = 0
        for start, length in sorted(by_doc[key]):
            assert start == at and length > 0
            at += length
        assert at == n
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= limits.tokens and len(pieces) <= limits.segments
    return len(by_sequence)


def test_packing_edges(edge_docs, no_docs, words):
    unique = [(k, i, words(t) + [2]) for k, (i, t) in enumerate(EDGES)]
    rows = packing.pack_documents(edge_docs.coalesce(1)).collect()
    assert sum(r.length for r in rows) == sum(len(ids) for _, _, ids in unique)
    of = {(i, len(ids)): ids for _, i, ids in unique}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(of[r.doc_id, r.doc_tokens][r.start : r.start + r.length], "<u4").tobytes())
    assert packing.pack_documents(no_docs).count() == 0


def test_packing_fills_sequences(docs, made_docs, words):
    rows = packing.pack_documents(docs.coalesce(1)).collect()
    tokens = {i: len(words(t)) + 1 for i, t, _ in made_docs}
    n = check_pieces([(r.doc_id, r.start, r.length, r.sequence_id, r.offset) for r in rows], tokens, packing.Limits())
    assert n == -(-sum(tokens.values()) // 4096)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(0, 3)), max_size=60))
def test_packer_keeps_all_limits(items):
    limits = packing.Limits(tokens=100, segments=5, loss_tokens=40)
    packer, rows, sums = packing.Packer(limits, window=500), [], {}
    for key, (n, kind) in enumerate(items):
        loss = np.arange(n) % 4 < kind
        sums[key] = np.concatenate([[0], np.cumsum(loss)])
        rows += packer.add(key, n, loss)
    rows += packer.finish()
    check_pieces([(p.key, p.start, p.length, p.sequence, p.offset) for p in rows], {k: n for k, (n, _) in enumerate(items)}, limits)
    bears = defaultdict(int)
    for p in rows:
        bears[p.sequence] += sums[p.key][p.start + p.length] - sums[p.key][p.start]
    assert all(b <= 40 for b in bears.values())


@pytest.mark.parametrize("loss", [None, 0, 1])
def test_very_many_short_examples_fill_sequences(loss):
    """Sixteen thousand examples a second at least, and no padding but in the last sequence, whatever number of segments that takes."""
    limits, rows = packing.Limits(tokens=256, segments=256, loss_tokens=256), []
    packer = packing.Packer(limits, window=1 << 15, most_items=1 << 12)
    began = time.perf_counter()
    for key in range(50_000):
        rows += packer.add(key, 1 + key % 3, None if loss is None else np.full(1 + key % 3, loss))
        assert packer.items <= 1 << 12
    rows += packer.finish()
    assert time.perf_counter() - began < 20
    n = check_pieces([(p.key, p.start, p.length, p.sequence, p.offset) for p in rows], {k: 1 + k % 3 for k in range(50_000)}, limits)
    assert n == -(-sum(1 + k % 3 for k in range(50_000)) // 256)


def test_as_many_are_taken_as_one_after_the_other_would_be():
    """Against a plain loop that looks at every example for every choice."""
    limits = packing.Limits(tokens=64, segments=9, loss_tokens=40)
    rng = np.random.default_rng(4)
    left = [(int(n), int(rng.integers(0, n + 1))) for n in rng.integers(1, 30, 80)]
    packer, rows = packing.Packer(limits, cut=False), []
    for key, (n, bears) in enumerate(left):
        rows += packer.add(key, n, np.arange(n) < bears)
    rows += packer.finish()
    got = [sorted(left[p.key] for p in rows if p.sequence == k) for k in range(max(p.sequence for p in rows) + 1)]
    whole, want = np.array([64, 9, 40]), []
    while left:
        room, own = whole.copy(), []
        while fits := [x for x in left if x[0] <= room[0] and room[1] and x[1] <= room[2]]:
            best = max(fits, key=lambda x: round(float(np.array([x[0], 1, x[1]]) / whole @ (room / whole)), 12))
            left.remove(best)
            own.append(best)
            room -= [best[0], 1, best[1]]
        want.append(sorted(own))
    assert got == want


def test_conversations_of_odd_rows(spark, words):
    rows = [(1, 0, "user", "hello there"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, "x y"), (None, 0, "assistant", "lost"), (None, 0, "assistant", "lost"), (3, 0, "assistant", "word " * 3000)]
    turns = spark.createDataFrame([(*r, "clash", 5) for r in rows], "conv_id long, turn long, role string, text string, start string, apart int").repartition(3)
    limits = packing.Limits(tokens=128, segments=4, loss_tokens=100)
    got = packing.pack_conversations(turns, limits).collect()
    tokens, bears = defaultdict(int), defaultdict(int)
    for conv, _, role, text in rows:
        n = len(words(text)) + 1
        tokens[conv] += n
        bears[conv] += n if role == "assistant" else 0
    assert {c: sum(r.length for r in got if r.conv_id == c) for c in tokens} == tokens
    assert {c: sum(r.loss_tokens for r in got if r.conv_id == c) for c in tokens} == bears
    lost = {(r.sequence_id, r.offset): r.length for r in got if r.conv_id is None}
    own = lambda r: r.conv_id if r.conv_id is not None else (r.sequence_id, r.offset)
    check_pieces([(own(r), r.start, r.length, r.sequence_id, r.offset) for r in got], {c: n for c, n in tokens.items() if c is not None} | lost, limits)
    assert sorted(r.start for r in got if r.conv_id is None) == [0, 0]
    assert packing.pack_conversations(turns.limit(0)).count() == 0


def test_packing_conversations(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    limits = packing.Limits(tokens=512, segments=8, loss_tokens=300)
    rows = packing.pack_conversations(turns, limits).collect()
    assert {r.conv_id for r in rows} == {r.conv_id for r in turns.select("conv_id").distinct().collect()}
    per = defaultdict(int)
    for r in rows:
        per[r.sequence_id] += r.loss_tokens
    assert max(per.values()) <= 300
