import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import DATA
from edge_cases import BLANKS, TEXTS, awkward, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from sylva.llm import packing, token_files, tokenize
from sylva.llm.bpe import byte_bpe
from sylva.llm.library_tokens import library_ids
from sylva.llm.queries import vocabulary

os.environ["TOKENIZERS_PARALLELISM"] = "false"
BYTE, WORD = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(path, text):
    return library(path).encode(text or "", add_special_tokens=False).ids


def split(ids, counts):
    ends = np.cumsum([0, *counts])
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


ODD = st.text(alphabet=st.sampled_from(list("abcdeE'stSTlrvm12 \t\n\r!?.,éüßÀŸŐǅƁİΣς\xa0\x85\x1c 漢字٣½²́👩‍")), max_size=80)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_own_bpe_equals_the_library(text):
    model, lib = byte_bpe(BYTE), library_cached(BYTE)
    ids, counts = model.encode([text])
    assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids
    assert model.decode(ids, counts) == [lib.decode(ids.tolist(), skip_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_fast_paths_equal_the_library(text):
    for path in (BYTE, WORD):
        assert library_ids(path).encode([text])[0].tolist() == library_cached(path).encode(text, add_special_tokens=False).ids


_loaded = {}


def library_cached(path):
    if path not in _loaded:
        _loaded[path] = library(path)
    return _loaded[path]


def test_runs_of_a_million_blanks():
    for path in (BYTE, WORD):
        for text in BLANKS:
            assert library_ids(path).encode([text])[0].tolist() == library_cached(path).encode(text, add_special_tokens=False).ids
    model, lib = byte_bpe(BYTE), library_cached(BYTE)
    for text in BLANKS:
        ids, counts = model.encode([text])
        assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids and model.decode(ids, counts) == [text]


def test_operators_take_runs_of_blanks(spark):
    df, lib = documents(spark, BLANKS), {p: library_cached(p) for p in (BYTE, WORD)}
    n = {p: [len(lib[p].encode(t, add_special_tokens=False).ids) for t in BLANKS] for p in lib}
    packed = defaultdict(int)
    for r in packing.pack(df, BYTE).collect():
        packed[r.doc_id] += r.length
    assert [packed[i] - 1 for i in range(len(BLANKS))] == n[BYTE]
    assert [r.n_tokens - 1 for r in sorted(token_files.write_and_read(df, WORD, end_id=1).collect())] == n[WORD]
    assert [r.n_tokens for r in sorted(tokenize.round_trip_digest(df, BYTE).collect())] == n[BYTE]


def test_long_words_are_walked_as_the_library_does():
    r, model, lib = random.Random(5), byte_bpe(BYTE), library_cached(BYTE)
    for letters in ("acgt", "abcdefghijklmnopqrstuvwxyz", "éß字漢", "-=*"):
        word = "".join(r.choice(letters) for _ in range(30_000))
        ids, _ = model.encode([f"{word} {word[:77]}{word}"])
        assert ids.tolist() == lib.encode(f"{word} {word[:77]}{word}", add_special_tokens=False).ids


def test_the_table_of_pieces_is_bounded_by_characters():
    model = byte_bpe(BYTE)
    model.encode(["ab" * 9_000_000])
    model.encode(["x"])
    assert model.table.index.chars < 1000


def test_every_token_and_any_ids_decode_as_in_the_library():
    model, lib = byte_bpe(BYTE), library_cached(BYTE)
    r = random.Random(1)
    runs = [[i] for i in range(0, 50257, 7)] + [[r.randrange(50257) for _ in range(r.randint(0, 9))] for _ in range(500)]
    found = model.decode(np.array([i for x in runs for i in x], np.uint32), np.array([len(x) for x in runs]))
    assert found == [lib.decode(x, skip_special_tokens=False) for x in runs]


def test_round_trip_of_awkward_tables(spark):
    found = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tokenize.round_trip_digest(awkward(spark), BYTE).collect()}
    lib = library_cached(BYTE)
    for doc_id, text in [*enumerate(TEXTS), (None, "some text of no id")]:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert (doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids, skip_special_tokens=False).encode())) in found
    assert tokenize.round_trip_digest(empty(spark), BYTE).count() == 0
    back = tokenize.decode(tokenize.encode(documents(spark), BYTE), BYTE)
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_bits():
    r = np.random.default_rng(0)
    for width in (1, 3, 8, 13, 16, 17, 32):
        ids = r.integers(0, 2**width, 1001).astype(np.uint32)
        data = token_files.pack_bits(ids, width)
        assert len(data) == -(-1001 * width // 8)
        assert (token_files.unpack_bits(data, 1001, width) == ids).all()
    assert [token_files.bits_for(n) for n in (1, 2, 3, 49408, 65536, 65537)] == [1, 1, 2, 16, 16, 17]


@pytest.mark.parametrize("width", [16, 13])
def test_random_access_in_a_shard(tmp_path, width):
    r = np.random.default_rng(1)
    docs = [(None if i == 0 else i, r.integers(0, 2**width, n).astype(np.uint32)) for i, n in enumerate([0, 5, 40_000, 1, 16_384, 16_385])]
    token_files.write_shard(str(tmp_path / "a.tok"), docs, width)
    shard = token_files.Shard(str(tmp_path / "a.tok"))
    assert shard.docs == [d for d, _ in docs]
    whole = np.concatenate([x for _, x in docs])
    for i, (_, x) in enumerate(docs):
        assert (shard.document(i) == x).all()
    for a, b in [(0, 0), (0, len(whole)), (16_383, 16_386), (40_000, 56_000), (len(whole) - 1, len(whole))]:
        assert (shard.tokens(a, b) == whole[a:b]).all()
    (tmp_path / "bad.tok").write_bytes(b"x" * 100)
    with pytest.raises(ValueError, match="not a token file"):
        token_files.Shard(str(tmp_path / "bad.tok"))


def expected_files(docs):
    at, out = 0, []
    for doc_id, text in docs:
        ids = np.array([*library_cached(WORD).encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((doc_id, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    return out


def test_token_files_are_in_order_over_many_shards(spark, tmp_path):
    docs = documents(spark, [t for t in TEXTS] * 3).repartition(3)
    manifest = token_files.write(docs, WORD, str(tmp_path / "tokens"), end_id=1, shard_tokens=500)
    assert manifest.count() > 5
    found = sorted(map(tuple, token_files.read(manifest).collect()))
    assert found == expected_files(list(enumerate(TEXTS * 3)))
    assert '"bits": 16' in token_files.describe(manifest.first().path)


def test_token_files_of_awkward_tables(spark):
    found = [tuple(r) for r in token_files.write_and_read(awkward(spark), WORD, 1).orderBy("start").collect()]
    docs = [(None, "some text of no id"), *sorted([*enumerate(TEXTS), (3, TEXTS[3]), (4, TEXTS[4])], key=lambda x: x[0])]
    assert found == expected_files(docs)
    assert token_files.write_and_read(empty(spark), WORD, 1).count() == 0


def test_plan_is_a_packing():
    r = random.Random(2)
    for _ in range(200):
        size = r.choice([1, 2, 7, 10, 64])
        histogram = {n: r.choice([1, 2, 3, 50]) for n in range(1, size + 1) if r.random() < 0.6}
        slots, room = defaultdict(list), defaultdict(list)
        for length, a, b, first, each, offset in packing.plan(histogram, size):
            for rank in range(a, b):
                k = rank - a
                room[first + k // each].append((offset + k % each * length, length))
                slots[length].append(rank)
        assert {n: sorted(x) for n, x in slots.items()} == {n: list(range(c)) for n, c in histogram.items()}
        for parts in room.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= size
        plain = best_fit([n for n in sorted(histogram, reverse=True) for _ in range(histogram[n])], size)
        assert len(room) == plain


def best_fit(lengths, size):
    left = []
    for n in lengths:
        fits = [i for i, x in enumerate(left) if x >= n]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= n
        else:
            left.append(size - n)
    return len(left)


def check_packing(found, docs, size=1024):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    total = 0
    for doc_id, text in docs:
        ids = np.array([*library_cached(BYTE).encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        parts = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [r.piece for r in parts] == list(range(len(parts))) and sum(r.length for r in parts) == len(ids)
        assert len(parts) == 1 or all(r.length == size for r in parts[1:])
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length])
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by_sequence), total


def test_packing_of_the_smallest_table_is_tight(spark):
    docs = spark.read.parquet(str(DATA / "sf0.001/documents.parquet"))
    n, total = check_packing(packing.pack(docs, BYTE).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert n <= -(-total // 1024) * 1.02 + 1


def test_packing_of_awkward_tables(spark):
    check_packing(packing.pack(documents(spark), BYTE).collect(), list(enumerate(TEXTS)))
    assert packing.pack(awkward(spark), BYTE).where("doc_id = 3").count() == 2
    assert packing.pack(empty(spark), BYTE).count() == 0
    same = documents(spark, ["one text"] * 500)
    assert check_packing(packing.pack(same, BYTE).collect(), [(i, "one text") for i in range(500)])[0] == -(-500 // (1024 // 3))


def test_idle_workers_hold_no_tokenizer(spark, monkeypatch):
    import pyarrow as pa

    made, real = [], packing.lean
    monkeypatch.setattr(packing, "lean", lambda *a: made.append(real(*a)) or made[-1])
    packing.pieces(documents(spark, ["a"]), BYTE, 1024, 2)
    encoder = library_ids(BYTE)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["plain text", "Ünïcödé"])], ["doc_id", "text"])
    assert sum(x.num_rows for x in made[0](iter([batch]))) == 2
    assert library_ids.cache_info().currsize == 0
    # the tokenizers library is there for texts that need it alone
    encoder = library_ids(BYTE)
    assert encoder.encode(["plain text"])[0].tolist() == ids_of(BYTE, "plain text") and "library" not in vars(encoder)
    assert encoder.encode(["漢字"])[0].tolist() == ids_of(BYTE, "漢字") and "library" in vars(encoder)
    assert encoder.vocab_size == library_cached(BYTE).get_vocab_size()
