import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken

from cratewise.llm import bpe
from cratewise.llm.queries import op5_byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "  ", "a", " a", "a \n b\n\n", "a  b  ", "they'll  don't we'LL \t\n 12 345", "aaaaaaaaaaaaa aaaa", "日本語 テキスト 🎵", "\r\n \r\n", "é é    é", "word " * 20_000,
         "x" * 5_000, "\x1c a  b　c", "<|endoftext|>", "ab" * 300 + " ba"]


@pytest.fixture(scope="module")
def public():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_matches_the_public_library(spark, docs_of, folder_of, public):
    got = {r.doc_id: r for r in op5_byte_bpe(spark, folder_of(documents=docs_of(list(enumerate(TEXTS)) + [(None, "no id")]))).collect()}
    assert set(got) == set(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        ids = public.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_given_documents(spark, public):
    from cratewise.llm.queries import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = {r.doc_id: public.encode_ordinary(r.text) for r in docs.collect()}
    for r in bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect():
        assert [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)] == want[r.doc_id]


def test_no_rows_and_repeated_ids(spark, docs_of):
    assert bpe.encode(docs_of([]), PATH, public_tokenizers.PATTERN).count() == 0
    rows = bpe.encode(docs_of([(1, "b"), (1, "a"), (1, "a")]), PATH, public_tokenizers.PATTERN)
    assert bpe.decode(rows, PATH).collect() == [(1, bytearray(b"a"))]


def test_small_replays_equal_large_ones(public, monkeypatch):
    monkeypatch.setattr(bpe, "REPLAY_GROUPS", 3)
    ranks = bpe.Ranks.read(PATH)
    texts = [t or "" for t in TEXTS]
    assert [x.tolist() for x in bpe.encode_texts(texts, public_tokenizers.PATTERN, ranks)] == [public.encode_ordinary(t) for t in texts]
