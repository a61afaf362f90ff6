import hashlib
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarry.llm import encoding, packing, queries


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_padding()
    t.no_truncation()
    return t


def raw(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_op8_equals_the_library(spark, sf, docs, library):
    got = {r.doc_id: r for r in queries.op8_bpe(spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = got[d["doc_id"]]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(raw(ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("speculate", [True, False])
def test_encoding_of_odd_texts(odd, empty, library, speculate):
    from .conftest import TEXTS

    rows = encoding.decode(encoding.encode(odd, speculate=speculate)).collect()
    want = sorted((raw(ids := library.encode(t or "", add_special_tokens=False).ids), library.decode(ids, skip_special_tokens=False)) for _, t in TEXTS)
    assert sorted((bytes(r.ids), r.decoded) for r in rows) == want
    assert encoding.encode(empty, decode=True).count() == 0


def check_pieces(pieces, window, want):
    """want: (doc_id, ids) of every document; pieces of equal doc_ids are told apart by their ids."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        documents[p.doc_id].append(p)
    padding = 0
    for rows in sequences.values():
        at = 0
        for p in sorted(rows, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0
    for key, ids in want.items():
        rows = sorted(documents.pop(key), key=lambda p: p.start)
        assert sum(p.length for p in rows) == len(ids)
        at = 0
        for p in rows:
            assert p.start == at and p.doc_tokens == len(ids)
            assert bytes(p.ids) == raw(ids[at : at + p.length]) if hasattr(p, "ids") else p.ids_crc32 == zlib.crc32(raw(ids[at : at + p.length]))
            at += p.length
    assert not documents


def test_op1_pieces(spark, sf, docs, library):
    want = {d["doc_id"]: [*library.encode(d["text"] or "", add_special_tokens=False).ids, 2] for d in docs}
    check_pieces(queries.op1_packing(spark, sf).collect(), 4096, want)


def test_packing_of_odd_rows(odd, empty, library):
    from .conftest import TEXTS

    alone = odd.where("doc_id <> 7 OR doc_id IS NULL")
    want = {k: [*library.encode(t or "", add_special_tokens=False).ids, 2] for k, t in TEXTS if k != 7}
    check_pieces(packing.pack(alone, window=64, open_windows=3).collect(), 64, want)
    assert sum(p.length for p in packing.pack(odd.where("doc_id = 7")).collect()) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for k, t in TEXTS if k == 7)
    assert packing.pack(empty).count() == 0
