import zlib
from collections import defaultdict

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from daybook.llm.packing import Capacity, best_fit, cut, pack_messages
from tests.llm.conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_packing(rows, texts, most):
    reference = Tokenizer.from_file(PATH)
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["rowid"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, text in enumerate(texts):
        ids = np.array([*reference.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(pieces[i], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in mine] == cut(len(ids), most)
        for k, r in enumerate(mine):
            assert r["piece"] == k
            part = ids[r["start"]:r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= most
    return len(bins)


def test_pieces_and_sequences(bodies):
    texts = [*ODD, "<|endoftext|> a <|endoftext|>b", *(f"word {i} " * (i % 40) for i in range(150))]
    rows = pack_messages(bodies(*texts), PATH, Capacity(tokens=64)).collect()
    used = check_packing(rows, texts, 64)
    total = sum(r["length"] for r in rows)
    assert used <= 1.05 * total / 64 + 1


def test_every_constraint_holds():
    lengths = np.sort(np.random.default_rng(1).integers(1, 60, 400))[::-1]
    for rule in ("residual_norm", "dot_product"):
        capacity = Capacity(tokens=100, pieces=4, attention=4000, rule=rule)
        bins, _ = best_fit(lengths, capacity)
        for b in np.unique(bins):
            mine = lengths[bins == b]
            assert mine.sum() <= 100 and len(mine) <= 4 and (mine ** 2).sum() <= 4000
    with pytest.raises(ValueError):
        best_fit(np.array([70]), Capacity(tokens=100, attention=4000))


def test_cut_and_empty(bodies):
    assert cut(5, 2) == [(0, 1), (1, 2), (3, 2)] and cut(4, 2) == [(0, 2), (2, 2)]
    assert pack_messages(bodies().limit(0), PATH).count() == 0
    rows = pack_messages(bodies("a b", "a b", rowids=[3, 3]), PATH).collect()
    assert sorted(r["offset"] for r in rows) == [0, 3]


def test_over_a_million_blanks_in_a_row(bodies):
    texts = ["a" + " " * 1_200_000 + "b <|endoftext|>", "after it"]
    rows = pack_messages(bodies(*texts), PATH).collect()
    check_packing(rows, texts, 2048)
