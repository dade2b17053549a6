"""Token ids, token files, the token table and packing, against the tokenizers library itself."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow.orc as orc
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dagtrail.llm import packing, token_files, token_table
from dagtrail.llm.encoding import Encoder
from tests.llm.samples import documents, plain, rows

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD_BPE)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_ids_are_those_of_the_library(path):
    library, encoder = Tokenizer.from_file(path), Encoder(path)
    for _, text, *_ in rows():
        assert np.frombuffer(encoder.packed(text), "<u4").tolist() == ids_of(library, text)


@settings(max_examples=300, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t\r\x0b\x0c\x1c\x85'.,s")), max_size=60))
def test_ids_of_any_text(library, text):
    assert np.frombuffer(_ENCODER.packed(text), "<u4").tolist() == ids_of(library, text)


_ENCODER = Encoder(WORD_BPE)


def order(row):
    return (row[0] is not None, row[0] or 0, row[1] is not None, row[1] or "")


@pytest.mark.parametrize("clash", [False, True])
def test_token_table(spark, tmp_path, library, clash):
    path = str(tmp_path / "table")
    token_table.write_token_table(documents(spark, clash=clash), path, WORD_BPE, end_id=1)
    table = token_table.read_token_table(spark, path)
    start, expected = 0, []
    for doc_id, text, *_ in sorted(rows(), key=order):
        ids = ids_of(library, text) + [1]
        expected.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert plain(token_table.token_digests(table)) == sorted(expected, key=repr)
    # what comes back is what was encoded, and a look-up of one document works
    assert table.where("doc_id = 13").first().token_ids == ids_of(library, rows()[13][1]) + [1]
    assert spark.read.orc(path).schema["token_ids"].dataType.simpleString() == "array<int>"


def test_token_table_has_filters_on_ids(spark, tmp_path):
    path = str(tmp_path / "table")
    token_table.write_token_table(documents(spark), path, WORD_BPE, end_id=1)
    plan = token_table.read_token_table(spark, path).where("doc_id = 13")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,13)" in plan

    files = list((tmp_path / "table").glob("*.orc"))
    assert sum(orc.ORCFile(f).nrows for f in files) == len(rows())


@pytest.mark.parametrize("hot", [7, None])
def test_an_id_with_a_third_of_all_rows_is_dealt_over_tasks(spark, hot):
    found = [(hot if i % 3 == 0 else i, "one text" if i % 2 else f"text {i % 5}", "en", "a", 1) for i in range(6000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spread = token_table.encode_documents(documents(spark, found), WORD_BPE, 1).groupBy("part").count().toPandas()["count"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) > 2 and spread.max() <= 2 * spread.median() and spread.sum() == len(found)


def test_empty_tables(spark, tmp_path):
    none = documents(spark, [])
    token_table.write_token_table(none, str(tmp_path / "table"), WORD_BPE, end_id=1)
    assert token_table.token_digests(token_table.read_token_table(spark, str(tmp_path / "table"))).count() == 0
    assert packing.pack_documents(none, WORD_BPE).count() == 0


@pytest.mark.parametrize("block_bytes", [2, 14, 1000, 1 << 20])
def test_token_files(spark, tmp_path, library, block_bytes):
    found = rows() if block_bytes > 14 else [r for r in rows() if len(r[1] or "") < 2000]
    path = str(tmp_path / "files")
    token_files.write_token_files(documents(spark, found, clash=True), path, WORD_BPE)
    counted = token_files.token_counts(spark, path, block_bytes).collect()
    assert sorted(r.n_tokens for r in counted) == sorted(len(ids_of(library, r[1])) for r in found)
    assert all(r.complete for r in counted)
    # documents of a file follow each other without gaps
    files = {}
    for r in counted:
        files.setdefault(r.file, []).append((r.document, r.start, r.n_tokens))
    for of_file in files.values():
        place = 0
        for i, (document, start, n) in enumerate(sorted(of_file)):
            assert (document, start) == (i, place)
            place += n + 1


@pytest.mark.parametrize("block_bytes", [2, 6, 64])
def test_files_by_hand(spark, tmp_path, block_bytes):
    folder = tmp_path / "files"
    folder.mkdir()
    ids = [5, 6, 0, 0, 7, 7, 7, 7, 7, 7, 7, 0, 1, 2]
    (folder / "a.bin").write_bytes(np.array(ids, "<u2").tobytes() + b"\x09")
    (folder / "b.bin").write_bytes(np.array([4, 4, 4], "<u2").tobytes())
    (folder / "c.bin").write_bytes(np.array([0], "<u2").tobytes())
    (folder / "d.bin").write_bytes(b"")
    counted = token_files.token_counts(spark, str(folder), block_bytes).collect()
    found = sorted((r.file[-5:], r.document, r.start, r.n_tokens, r.complete) for r in counted)
    assert found == [
        ("a.bin", 0, 0, 2, True), ("a.bin", 1, 3, 0, True), ("a.bin", 2, 4, 7, True), ("a.bin", 3, 12, 2, False),
        ("b.bin", 0, 0, 3, False), ("c.bin", 0, 0, 0, True),
    ]


def check_packed(packed, capacity):
    """Sequences are gapless from 0 and not longer than may be; how many there are."""
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in sequences.values():
        place = 0
        for offset, length in sorted(placed):
            assert offset == place
            place += length
        assert place <= capacity
    return len(sequences)


@pytest.mark.parametrize("capacity", [16, 2048])
def test_packing(spark, library, capacity):
    found = documents(spark, clash=True)
    packed = packing.pack_documents(found, WORD_BPE, end_id=0, capacity=capacity).collect()
    expected = []
    for doc_id, text, *_ in rows():
        ids = ids_of(library, text) + [0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected.append((doc_id, piece, at, len(part), crc(part)))
    assert sorted((tuple(r)[:5] for r in packed), key=repr) == sorted(expected, key=repr)
    least = -(-sum(e[3] for e in expected) // capacity)
    assert least <= check_packed(packed, capacity) <= least + 2


def test_packed_pieces_keep_their_ids(spark, library):
    packed = packing.pack_documents(documents(spark, clash=True), WORD_BPE, end_id=0, capacity=64, with_ids=True)
    assert packed.schema["token_ids"].dataType.simpleString() == "array<int>"
    found = packed.collect()
    check_packed(found, 64)
    assert all(len(r.token_ids) == r.length and crc(r.token_ids) == r.ids_crc32 for r in found)
    # documents come back from their pieces
    for doc_id in (9, 13, 17):
        pieces = sorted((r for r in found if r.doc_id == doc_id), key=lambda r: r.piece)
        assert [i for r in pieces for i in r.token_ids] == ids_of(library, rows()[doc_id][1]) + [0]
    none = packing.pack_documents(documents(spark, []), WORD_BPE, with_ids=True)
    assert none.count() == 0 and none.columns[-1] == "token_ids"


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=25))
def test_plans_use_every_piece_once(counts):
    used = {}
    plan = packing.plan_sequences(counts, 60)
    for chosen, times in plan:
        assert sum(chosen) <= 60 and times > 0
        for length in chosen:
            used[length] = used.get(length, 0) + times
    assert used == counts
    places = packing._Places(plan)
    taken = {}
    for length, n in counts.items():
        sequence, offset = places.of(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            taken.setdefault(s, []).append((o, length))
    assert len(taken) == sum(t for _, t in plan)
    for placed in taken.values():
        at = 0
        for o, length in sorted(placed):
            assert o == at
            at += length


@pytest.mark.parametrize(
    "counts, sequences",
    [({10: 3}, 3), ({5: 4}, 2), ({7: 2, 3: 2}, 2), ({4: 1, 3: 2}, 1), ({6: 3, 2: 6}, 3), ({1: 100}, 10), ({6: 2, 5: 2}, 3)],
)
def test_exact_combinations_fill_the_gaps(counts, sequences):
    assert sum(t for _, t in packing.plan_sequences(counts, 10)) == sequences


def test_packing_wastes_little_of_many_lengths():
    lengths = np.clip(np.random.default_rng(1).lognormal(6, 1.1, 20_000).astype(int), 1, 2048)
    values, n = np.unique(lengths, return_counts=True)
    plan = packing.plan_sequences(dict(zip(values.tolist(), n.tolist(), strict=True)))
    assert sum(t for _, t in plan) <= -(-lengths.sum() // 2048) * 1.001 + 1


def test_long_chunks_are_not_remembered():
    encode = Encoder(WORD_BPE)
    texts = [f"{'x' * 500}{i} " + "é" * 500 + f"{i} word{i}" for i in range(20)]
    assert [encode.packed(t) for t in texts] == [encode.packed(t) for t in texts]
    held = [*encode._chunks, *encode._chunks._words]
    assert "word3" in held and max(map(len, held)) <= 64
