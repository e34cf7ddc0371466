import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cratewise.llm import wordbpe
from cratewise.llm.queries import op12_speculative_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", " ", "  \t", "a", "aaaaaaaaaaaaaaaaaaaaaaa bababababab", "They'll DON'T we've 'tis rock'n'roll", "word " * 5_000, "x" * 3_000, "日本語 テキスト 🎵 ΑΣ ΟΔΟΣ Σ İstanbul ǅ ﬁ",
         "é é ́ a\u0085b　c\x1cd", "<|startoftext|>Hello<|endoftext|> <|endoftext|>x <|endof text|>", "</w> a</w>b </w></w>", "12 345.67e-8 $$$!!!...", "ß ÀÖ × ÷ ñÑ", "\r\n\r\n a\nb", "�\u0000\u0001"]


@pytest.fixture(scope="module")
def public():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return wordbpe.Encoder(wordbpe.Merges.read(PATH))


def digest(ids):
    return hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


def test_matches_the_public_library(spark, docs_of, folder_of, public):
    got = {r.doc_id: r for r in op12_speculative_bpe(spark, folder_of(documents=docs_of(list(enumerate(TEXTS)) + [(None, "no id")]))).collect()}
    assert set(got) == set(range(len(TEXTS)))
    for i, text in enumerate(TEXTS):
        ids = public.encode(text or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), digest(ids)), text
        assert got[i].decoded_sha256 == hashlib.sha256(public.decode(ids, skip_special_tokens=False).encode()).hexdigest(), text


def test_given_documents(spark, public):
    from cratewise.llm.queries import table

    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = {r.doc_id: public.encode(r.text, add_special_tokens=False).ids for r in docs.collect()}
    for r in wordbpe.encode(docs, PATH).collect():
        assert [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)] == want[r.doc_id]


def test_no_rows_and_repeated_ids(spark, docs_of):
    assert wordbpe.encode(docs_of([]), PATH).count() == 0
    rows = wordbpe.encode(docs_of([(1, "b"), (1, "a"), (1, "a")]), PATH)
    assert wordbpe.decode(rows, PATH).collect() == [(1, bytearray(b"a</w>"))]


def test_every_word_equals_exact_merging(encoder, public):
    """Words of few letters, with runs and overlaps, and words joined from tokens: where proposals often fail."""
    rng = random.Random(5)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for letters in ("a", "ab", "aeh", "estin", "abcdefghijklmnopqrstuvwxyz") for _ in range(1_500)]
    pieces = [w for w in encoder.merges.words if w.isascii() and w.isalpha() and w.islower()]
    words += ["".join(rng.choices(pieces, k=rng.randrange(2, 5))) for _ in range(4_000)]
    before = encoder.failed
    got = encoder.tokens([w[:-1] + chr(ord(w[-1]) + 256) for w in words])
    assert got == [e.ids for e in public.encode_batch(words, add_special_tokens=False)]
    assert 0.02 < (encoder.failed - before) / len(words) < 0.9


def test_compatible_pairs_are_those_that_merging_keeps_apart(encoder):
    rng = random.Random(9)
    merges = encoder.merges
    inner = [k for k, w in enumerate(merges.words) if w and all(ord(c) < 256 for c in w) and len(w) < 6]
    import numpy as np

    pairs = [(rng.choice(inner), rng.choice(inner)) for _ in range(4_000)] + [(k, k) for k in inner[:1_500]]
    got = merges.compatible(*np.array(pairs, np.int64).T)
    want = [merges.exact(merges.words[a] + merges.words[b], encoder.pairs) == [a, b] for a, b in pairs]
    assert got.tolist() == want and 0 < sum(want) < len(want)


def test_small_batches_and_forgetting(encoder, public, monkeypatch):
    monkeypatch.setattr(wordbpe, "TESTED_WORDS", 3)
    monkeypatch.setattr(wordbpe, "REMEMBERED_WORDS", 5)
    texts = [t or "" for t in TEXTS]
    for text in texts:
        ids, ends = encoder.encode([text, "and the house"])
        assert ids[: ends[1]].tolist() == public.encode(text, add_special_tokens=False).ids
