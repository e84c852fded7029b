import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import elias_fano, token_counts
from newsloom.llm.byte_ids import ByteIds, tokenizer_path
from newsloom.llm.packing import Places, cut_pieces, pack_documents, plan_sequences
from newsloom.llm.piece_codec import PieceCodec, piece_codes
from newsloom.llm.piece_model import model_path
from newsloom.llm.token_counts import Transducer, chunk_map, count_all, count_texts, count_tokens, scan, with_first_space
from newsloom.llm.token_files import Shard, pack_shard, read_token_files, write_token_files
from newsloom.llm.workers import Memo

ODD = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "a", "foo", "Bar", "'s", "12", "é"]
ODD += ["日本", "🙂", "<|endoftext|>", "!!", "_", "\x00", "ß", "́", "﻿", "½", "▁", "▁▁", "<s>", "==", "the", "ing"]


def odd_texts(n, most, seed):
    pick = random.Random(seed)
    return ["".join(pick.choice(ODD) for _ in range(pick.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path())


def library_ids(hf, texts):
    return [e.ids for e in hf.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def test_byte_ids_are_the_librarys(hf):
    texts = [None, "", " ", *odd_texts(5000, 14, 1), "x" * 5000, " " * 3000]
    ids, offsets = ByteIds.of(tokenizer_path()).encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == library_ids(hf, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=700))
def test_elias_fano_round_trip(values):
    values = sorted(values)
    read = elias_fano.EliasFano(elias_fano.encode(np.array(values, np.int64)))
    assert read.all().tolist() == values
    assert [read[i] for i in range(len(values))] == values


def test_elias_fano_is_small():
    blob = elias_fano.encode(np.cumsum(np.random.RandomState(0).randint(1, 2000, 10_000)))
    assert len(blob) < 10_000 * 13 / 8 + 400


def test_shard_reads_single_documents():
    ids = np.arange(10, dtype=np.uint32)
    shard = Shard(pack_shard([None, -5, 7], ids, np.array([2, 2, 10])))
    assert [shard.doc_id(i) for i in range(3)] == [None, -5, 7]
    assert [shard.document(i).tolist() for i in range(3)] == [[0, 1], [], [2, 3, 4, 5, 6, 7, 8, 9]]
    assert Shard(pack_shard([3], np.array([70_000], np.uint32), np.array([1]))).document(0).tolist() == [70_000]


ROWS = [(5, "b and c"), (2, None), (9, ""), (7, "long word " * 3000), (7, "same id"), (None, "no id"), (1, "a")]


def table(spark, rows):
    """Documents with columns whose names clash with those of results."""
    rows = [(i, t, 1, "x", True) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, point string, kept boolean").repartition(3)


def test_token_files(spark, hf, tmp_path):
    write_token_files(table(spark, ROWS), str(tmp_path / "a"), shard_bytes=100)
    rows = [tuple(r) for r in read_token_files(spark, str(tmp_path / "a")).orderBy("start").collect()]
    assert [r[0] for r in rows] == [None, 1, 2, 5, 7, 7, 9]
    ids = {(i, t): x + [2] for (i, t), x in zip(ROWS, library_ids(hf, [t for _, t in ROWS]))}
    expected = sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4"))) for (i, _), x in ids.items())
    assert sorted((str(r[0]), r[2], r[3]) for r in rows) == expected
    starts = np.cumsum([0] + [r[2] for r in rows])[:-1]
    assert [r[1] for r in rows] == starts.tolist()
    write_token_files(table(spark, ROWS).limit(0), str(tmp_path / "b"))
    assert read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_cut_pieces():
    document, piece, start, length = cut_pieces(np.array([1, 5, 8, 9]), 4)
    assert list(zip(document, piece, start, length)) == [
        (0, 0, 0, 1), (1, 0, 0, 1), (1, 1, 1, 4), (2, 0, 0, 4), (2, 1, 4, 4), (3, 0, 0, 1), (3, 1, 1, 4), (3, 2, 5, 4),
    ]


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 50), max_size=24))
def test_plan_uses_every_piece_once(counts):
    plan = plan_sequences(counts, 24)
    used = {}
    for times, lengths in plan:
        assert times > 0 and 0 < sum(lengths) <= 24
        for x in lengths:
            used[x] = used.get(x, 0) + times
    assert used == counts
    total = sum(k * v for k, v in counts.items())
    assert sum(t for t, _ in plan) <= 2 * -(-total // 24) + 1
    length = np.array([k for k, v in counts.items() for _ in range(v)], np.int64)
    number = np.array([i for v in counts.values() for i in range(v)], np.int64)
    if len(length):
        sequence, offset = Places(plan).of(length, number)
        held = {}
        for s, o, n in sorted(zip(sequence.tolist(), offset.tolist(), length.tolist())):
            assert held.get(s, 0) == o
            held[s] = o + n
        assert max(held.values()) <= 24


def test_exact_complements_fill_sequences():
    assert plan_sequences({10: 2, 6: 3, 4: 3, 3: 1, 1: 1}, 10) == [(2, [10]), (3, [6, 4]), (1, [3, 1])]
    assert plan_sequences({6: 2, 3: 2, 1: 2}, 10) == [(2, [6, 3, 1])]
    assert sum(times for times, _ in plan_sequences({5: 2, 3: 2, 2: 2}, 10)) == 2


def fewest(lengths, capacity):
    """The smallest number of sequences, by trying everything."""
    best = [len(lengths)]

    def place(at, rooms):
        if len(rooms) >= best[0]:
            return
        if at == len(lengths):
            best[0] = len(rooms)
            return
        for i in sorted({room: i for i, room in enumerate(rooms) if room >= lengths[at]}.values()):
            place(at + 1, [*rooms[:i], rooms[i] - lengths[at], *rooms[i + 1 :]])
        place(at + 1, [*rooms, capacity - lengths[at]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best[0]


def test_plans_against_the_optimum():
    pick = random.Random(6)
    exact = 0
    for _ in range(300):
        lengths = [pick.randint(1, 20) for _ in range(pick.randint(1, 9))]
        counts = {x: lengths.count(x) for x in lengths}
        made, least = sum(t for t, _ in plan_sequences(counts, 20)), fewest(lengths, 20)
        assert least <= made <= least + 1
        exact += made == least
    assert exact >= 290


def test_gaps_are_filled_by_three_lengths():
    assert plan_sequences({7: 1, 6: 1, 5: 1, 2: 1}, 20) == [(1, [7, 6, 5, 2])]
    pick = random.Random(1)
    exact = 0
    for _ in range(100):
        counts = {}
        for _ in range(6):
            cuts = [0, *sorted(pick.sample(range(1, 200), 3)), 200]
            for a, b in zip(cuts, cuts[1:]):
                counts[b - a] = counts.get(b - a, 0) + 1
        made = sum(t for t, _ in plan_sequences(counts, 200))
        assert made <= 7
        exact += made == 6
    assert exact >= 60



def test_pack_documents(spark, hf):
    rows = [tuple(r) for r in pack_documents(table(spark, ROWS), capacity=64).collect()]
    ids = [(i, x + [0]) for (i, _), x in zip(ROWS, library_ids(hf, [t for _, t in ROWS]))]
    expected = []
    for i, x in ids:
        pieces = -(-len(x) // 64)
        first = len(x) - 64 * (pieces - 1)
        for p in range(pieces):
            at, n = (0, first) if p == 0 else (first + 64 * (p - 1), 64)
            expected.append((str(i), p, at, n, zlib.crc32(np.array(x[at : at + n], "<u4"))))
    assert sorted((str(r[0]), *r[1:5]) for r in rows) == sorted(expected)
    places = sorted((r[5], r[6], r[3]) for r in rows)
    held = {}
    for s, o, n in places:
        assert held.get(s, 0) == o
        held[s] = o + n
    assert len(held) <= -(-sum(len(x) for _, x in ids) // 64) + 1
    assert pack_documents(table(spark, ROWS).limit(0)).count() == 0


def piece_texts():
    return [None, "", " ", *odd_texts(4000, 14, 2), *(" " * i for i in range(40)), *("x" + " " * i + "y" for i in range(40))]


def test_counts_are_the_librarys(sp):
    texts = [*piece_texts(), "".join(odd_texts(300, 20, 5)), "ab" * 3000]
    found = count_texts(Transducer.of(model_path()), pa.array(texts, pa.string()), Memo())
    assert found.tolist() == [len(x) for x in sp.encode([t or "" for t in texts])]


def test_chunk_maps_compose(sp):
    machine = Transducer.of(model_path())
    for text in odd_texts(300, 30, 3):
        led = with_first_space(pa.array([text]))[0].as_py()
        for size in (1, 3, 7):
            parts = [led[i : i + size] for i in range(0, len(led), size)]
            if parts:
                assert count_all(machine, scan(machine, [chunk_map(machine, p) for p in parts])) == len(sp.encode(text))


def test_counts_without_kept_states(sp, monkeypatch):
    monkeypatch.setattr(token_counts, "MOST_STATES", 5)
    texts = odd_texts(500, 12, 4)
    machine = Transducer(Transducer.of(model_path()).model)
    assert count_texts(machine, pa.array(texts), Memo()).tolist() == [len(x) for x in sp.encode(texts)]


def test_count_tokens(spark, sp):
    rows = {str((r[0], r[1])): tuple(r)[1:] for r in count_tokens(table(spark, ROWS), limit=4096).collect()}
    assert len(rows) == len(ROWS)
    for i, t in ROWS:
        n = len(sp.encode(t or ""))
        assert rows[str((i, len((t or "").encode())))] == (len((t or "").encode()), n, n > 4096)
    assert count_tokens(table(spark, ROWS).limit(0)).count() == 0


def test_codec_is_the_librarys(sp):
    codec, texts = PieceCodec.of(model_path()), [*piece_texts(), "z" * 2000, "日" * 700]
    ids, offsets = codec.encode(pa.array(texts, pa.string()))
    each = [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert each == sp.encode([t or "" for t in texts])
    assert [codec.decode(x) for x in each] == [sp.decode(x) for x in each]


def test_piece_codes(spark, sp):
    rows = piece_codes(table(spark, ROWS), keep_ids=True).collect()
    expected = sorted((str(i), sp.encode(t or "")) for i, t in ROWS)
    assert sorted((str(r["doc_id"]), r["ids"]) for r in rows) == expected
    texts = {(str(i), zlib.crc32((t or "").encode())) for i, t in ROWS}
    assert {(str(r["doc_id"]), r["decoded_crc32"]) for r in rows} == texts
    assert piece_codes(table(spark, ROWS).limit(0)).count() == 0
