import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm.packing import byte_bpe, capacities, pack, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_gives_the_ids_of_the_tokenizers_library(tokenizer, rows):
    encode = byte_bpe(PATH)
    texts = [r[1] or "" for r in rows] + ["it's we'll  two  spaces\n\n end ", "1234 abc123 ½ ²", "<|endoftext|> in a text", "\x00\x01 ퟿", "a" * 3000 + " \t\n", "日本語テキスト 한국어"]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_pieces_tile_documents_and_sequences(docs, rows, tokenizer):
    found = pack_documents(docs, PATH, block_tokens=10_000).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc_id, text in {r[0]: r[1] for r in rows}.items():
        ids = ids_of(tokenizer, text)
        repeats = sum(1 for r in rows if r[0] == doc_id)
        pieces = sorted(by_doc[doc_id], key=lambda r: r["start"])
        assert sum(p["length"] for p in pieces) == repeats * len(ids)
        for p in pieces:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()
            assert (p["doc_tokens"], p["ids_crc32"]) == (len(ids), zlib.crc32(part))
    assert set(by_doc) == {r[0] for r in rows}
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)  # no padding


def test_pack_balances_cost():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 900, 400).tolist()
    pieces = pack(lengths, 2048, 1.0, 1 / 2048)
    assert sum(p[2] for p in pieces) == sum(lengths)
    load = defaultdict(float)
    for _, _, _, s, _, cost in pieces:
        load[s] += cost
    full = [v for s, v in load.items() if capacities(sum(lengths), 2048)[s] == 2048]
    assert max(full) < 1.6 * min(full)


def test_descending_documents_go_to_the_lowest_cost_sequence_with_room():
    pieces = pack([5, 4, 3, 3, 1], 8, 1.0, 0.0)  # room for 16: two sequences of 8
    first = [p for p in pieces if p[0] == 0][0]
    second = [p for p in pieces if p[0] == 1][0]
    assert first[3] != second[3]
    third = [p for p in pieces if p[0] == 2][0]
    assert third[3] == second[3]  # cost 4 is below 5


def test_empty_and_clashing(empty, wide, rows):
    assert pack_documents(empty, PATH).count() == 0
    assert {r["doc_id"] for r in pack_documents(wide, PATH).collect()} == {r[0] for r in rows}
