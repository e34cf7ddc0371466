import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cratewise.llm import align
from cratewise.llm.queries import op11_token_alignment, table
from cratewise.llm.wordbpe import byte_characters

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "a", " a", "a ", "Hello, the thtionions of\n\nyou  and the", "unbelievable unbelievable the the", "日本語 テキスト 🎵 é", "▁ has a piece mark", "x ▁", "<|endoftext|> <s> </s> <0x0A>",
         "a\u0085b　c \t d\x1ce \x1c f", "tab\tthe  end \n", "word " * 3_000, "x" * 2_000, "\u0000 null", "ééé", "1234567 89 e-mail@x.y"]


@pytest.fixture(scope="module")
def public():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def plain(public, given):
    """The result by walking over byte sets, from whole texts."""
    a_tok, b_tok = public
    characters = byte_characters()
    parsed, counts = {}, Counter()
    for i, text in given.items():
        whole = (" " + (text or "")).encode()
        a = [(k, bytes(characters[c] for c in a_tok.id_to_token(k))) for k in a_tok.encode(whole.decode(), add_special_tokens=False).ids]
        b = [(k, bytes([int(p[3:-1], 16)]) if b_tok.is_byte(k) else p.replace("▁", " ").encode()) for k in b_tok.encode(text or "") for p in [b_tok.id_to_piece(k)]]
        if not text or b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
            parsed[i] = None
            continue
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (a, b)]
        links = [(a[j][0], b[k][0]) for j in range(len(a)) for k in range(*_near(ends, b, j, len(a[j][1]))) if ends[0][j] - len(a[j][1]) < ends[1][k] and ends[1][k] - len(b[k][1]) < ends[0][j]]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, at, to = [], 0, 0
        for end in both:
            one, two = [], []
            while at < len(a) and ends[0][at] <= end:
                one.append(str(a[at][0]))
                at += 1
            while to < len(b) and ends[1][to] <= end:
                two.append(str(b[to][0]))
                to += 1
            groups.append(",".join(one) + "|" + ",".join(two))
        parsed[i] = (len(a), len(b), groups, links)
        counts.update(links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = {}
    for i, x in parsed.items():
        if x is None:
            out[i] = (0, 0, 0, 0, 0, 0, "")
        else:
            n_a, n_b, groups, links = x
            out[i] = (n_a, n_b, len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest())
    return out


def _near(ends, b, j, length):
    import bisect

    return bisect.bisect_right(ends[1], ends[0][j] - length), min(len(b), bisect.bisect_left(ends[1], ends[0][j]) + 1)


def rows_of(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


def test_odd_texts_equal_brute_force(spark, docs_of, folder_of, public):
    given = dict(enumerate(TEXTS))
    assert rows_of(op11_token_alignment(spark, folder_of(documents=docs_of([*given.items(), (None, "no id")])))) == plain(public, given)


def test_given_documents_in_many_blocks(spark, public, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_CHUNKS", 50)  # seen by forked workers that start after this
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = plain(public, {r.doc_id: r.text for r in docs.collect()})
    assert rows_of(op11_token_alignment(spark, "/root/testdata/sf0.001")) == want
    assert rows_of(align.align(docs.repartition(7), *PATHS)) == want


def test_no_rows_and_repeated_ids(spark, docs_of):
    assert align.align(docs_of([]), *PATHS).count() == 0
    assert rows_of(align.align(docs_of([(1, "b"), (1, "a a"), (1, "a a")]), *PATHS))[1][:4] == (2, 2, 2, 2)


def test_terminals_of_random_cuts():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 30))
        a, b = (np.append(np.sort(rng.choice(np.arange(1, n), rng.integers(0, n), replace=False)) if n > 1 else [], n).astype(np.int64) for _ in range(2))
        got = align.terminals(a, b)
        both = np.intersect1d(a, b)
        want = [int(np.searchsorted(a, both[np.searchsorted(both, e)])) for e in [*a, *b]]
        assert got.tolist() == want


def test_blocks_close_and_add_up(public):
    with open(PATHS[0], encoding="utf-8") as f, open(PATHS[1], "rb") as g:
        block = align.Block(align.Pair(f.read(), g.read()), 0)
    list(block.rows([1, 2], ["the thing the", "the"]))
    list(block.rows([3], ["thing other"]))
    structure, keys, n = block.structure()
    assert n.sum() == sum(len(c) for c in [[1], [1], [1], [1], [1], [1]]) and (np.diff(keys) > 0).all() and len(structure)
