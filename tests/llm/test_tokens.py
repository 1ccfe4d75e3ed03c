import random
import zlib
from collections import Counter

import numpy as np
import pytest

from shardloom.llm import packing, simple8b
from shardloom.llm.common import fresh_path
from shardloom.llm.queries import tokenizer_file
from shardloom.llm.tokens import UnitEncoder, encoder


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_units_encode_as_whole_texts(encode):
    r = random.Random(3)
    parts = [" ", "  ", "\n", "a", "b", "é", "1", " '", "s", "\t", " ", "😀", "don't", " x", "　", ".", "", " \n", "\x1c", "Ġ"]
    texts = ["".join(r.choices(parts, k=r.randrange(25))) for _ in range(3000)] + ["", " ", "word " * 500]
    got = encoder(tokenizer_file()).encode(texts)
    for text, raw in zip(texts, got):
        assert np.frombuffer(raw, "<u4").tolist() == encode(text), repr(text)


def test_added_tokens_encode_as_the_library_does(encode):
    r = random.Random(8)
    parts = [" ", "a", "word", "<|endoftext|>", " <|endoftext|> ", "<|endof", "text|>", "\n", "é", "<|endoftext|"]
    texts = ["one <|endoftext|> two", "<|endoftext|>", " <|endoftext|>", "plain words", ""] + ["".join(r.choices(parts, k=r.randrange(12))) for _ in range(500)]
    assert encode(texts[0]) == [505, 220, 50256, 734]
    for text, raw in zip(texts, encoder(tokenizer_file()).encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == encode(text), repr(text)


def test_known_units_are_not_worked_out_again(encode):
    e = UnitEncoder(tokenizer_file())
    text = "first some known words and 12 others, été end. " * 3 + "signs!?... (x) " + "y" * 200 + " z"
    e.encode([text])
    asked, words = [], e._words
    e._words = lambda found: asked.extend(found) or words(found)
    again = text.replace("others", "unseen") + " known, words. été!"
    assert np.frombuffer(e.encode([again])[0], "<u4").tolist() == encode(again)
    assert asked.count("unseen") == 1 and not {"some", "known", "words", "12", "été"} & set(asked)


@pytest.mark.parametrize("n", [0, 1, 2, 59, 60, 61, 119, 5000])
def test_simple8b_round_trip(n):
    rng = np.random.default_rng(n)
    for top in (1, 2, 16, 20, 32):
        ids = rng.integers(0, 2**top, n).astype(np.uint32)
        ids[rng.random(n) < 0.05] = rng.integers(0, 2**32)
        words, escaped = simple8b.pack(ids)
        assert (simple8b.unpack(words, escaped, n) == ids).all()
        assert len(words) <= max(1, n)


def test_blocks_and_groups():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 2**21, k).astype("<u4") for k in (0, 1, 7000, 3)]
    content = b"".join(simple8b.block_bytes([4, None, 6, 7], [p.tobytes() for p in parts]) + b"\n" for _ in range(3))
    found = list(simple8b.blocks_of(content))
    assert len(found) == 3
    for docs, nulls, lengths, words, escaped, before, n in found:
        assert docs.tolist() == [4, 0, 6, 7] and nulls.tolist() == [0, 1, 0, 0] and lengths.tolist() == [0, 1, 7000, 3]
        ids = simple8b.unpack(words, escaped, n)
        assert (ids == np.concatenate(parts)).all()
        groups = [simple8b.unpack_group(words, escaped, before, n, g) for g in range(len(before))]
        assert (np.concatenate(groups) == ids).all()


def test_token_files(spark, documents, rows, nothing, encode):
    got = sorted(simple8b.op3(documents, tokenizer_file()).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in got]
    assert [i for i in ids if i is not None] == sorted(i for i, _ in rows if i is not None) and ids[:2] == [None, None]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    want = Counter((i, len(t) + 1, zlib.crc32(np.array([*t, 2], "<u4").tobytes())) for i, t in ((i, encode(t)) for i, t in rows))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert simple8b.op3(nothing, tokenizer_file()).count() == 0
    path = fresh_path(spark, "files")
    simple8b.write_token_files(documents.where("doc_id < 50"), path, tokenizer_file())
    back = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in simple8b.read_token_files(spark, path).collect()}
    assert back == {i: [*encode(t), 2] for i, t in rows if i is not None and i < 50}


def test_packing(documents, rows, nothing, encode):
    pieces = packing.pack_best_fit(packing.token_pieces(documents, tokenizer_file(), with_ids=True))
    got = pieces.collect()
    whole = Counter((i, len(t) + 1) for i, t in ((i, encode(t)) for i, t in rows))
    assert sum(r.length for r in got) == sum(n * k for (_, n), k in whole.items())
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length and 0 < r.length <= 2048 for r in got)
    assert all(r.length == 2048 for r in got if r.piece > 0)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for parts in by.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by) <= -(-sum(r.length for r in got) // 2048) + 1
    made = {r.sequence_id: r for r in packing.assemble(pieces).collect()}
    assert all(made[s].ids == b"".join(r.ids for r in sorted(p, key=lambda r: r.offset)) for s, p in by.items())
    assert packing.op10(nothing, tokenizer_file()).count() == 0


def test_best_fit_runs_match_best_fit_one_by_one():
    r = random.Random(2)
    for _ in range(60):
        capacity = r.choice([10, 37, 100])
        counts = Counter(r.randrange(1, capacity + 1) for _ in range(r.randrange(1, 120)))
        table, opened = packing.best_fit_runs(dict(counts), capacity)
        free = []
        for length in sorted(counts.elements(), reverse=True):  # best-fit decreasing
            fits = [f for f in free if f >= length]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - length)
            else:
                free.append(capacity - length)
        assert opened == len(free)
        ends = np.append(table[1:, 1], 0)
        size = [int(ends[i]) - int(t[1]) if i + 1 < len(table) and table[i + 1, 0] == t[0] else counts[int(t[0])] - int(t[1]) for i, t in enumerate(table)]
        room = Counter()
        for t, n in zip(table, size):
            for k in range(n):
                room[int(t[2]) + k] += int(t[0])
        assert max(room.values()) <= capacity and sum(room.values()) == sum(k * n for k, n in counts.items())
    with pytest.raises(ValueError):
        packing.best_fit_runs({11: 1}, 10)
