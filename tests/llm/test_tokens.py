"""Token files, byte-level BPE and token counts against the libraries and plain programs."""

import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from corpusloom.llm import op1_tokens as H
from corpusloom.llm import op5_bpe as B
from corpusloom.llm import op8_counts as U

WORDS = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_token_files(spark, odd_docs, odd_rows, no_docs):
    t = Tokenizer.from_file(WORDS)
    got = H.token_files(odd_docs, WORDS, 2).collect()
    want = sorted((-1 if i is None else i, len(ids), crc(ids)) for i, x in odd_rows for ids in [[*t.encode(x or "", add_special_tokens=False).ids, 2]])
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert H.token_files(no_docs, WORDS, 2).count() == 0


@pytest.mark.parametrize("stretch", [H.STRETCH, 40, 7])
def test_words_are_encoded_as_whole_texts(monkeypatch, stretch):
    """Special tokens in a text are special, as the library has them; stretches end within texts and words."""
    monkeypatch.setattr(H, "STRETCH", stretch)
    t, e, dice = Tokenizer.from_file(WORDS), H.WordEncoder(WORDS), random.Random(3)
    letters = [*"aAbß é'’s.,!12\n\t\x1c\x85\u00a0\u3000\x01İΣσς中🙂é-ȺɏŉÀÞ×÷ªº\u0301\u212a", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "don't", "we'll ", " the "]
    texts = ["".join(dice.choice(letters) for _ in range(dice.randrange(60))) for _ in range(1500)] + ["", None, "x" * 500, "中" * 300, "a <|endoftext|> b"]
    ids, n = e.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert e.encode(pa.array([], pa.string()))[0].tolist() == []


def test_small_memories_and_other_tokenizers(monkeypatch, tmp_path):
    monkeypatch.setattr(H, "REMEMBERED_PIECES", 30)
    monkeypatch.setattr(H, "REMEMBERED_WORDS", 5)
    monkeypatch.setattr(H, "STRETCH", 200)
    said = json.load(open(WORDS))
    said["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(said))
    texts = [f"word{i % 7} Other{'x' * (i % 90)} more, {i}" for i in range(200)]
    for path, by_word in ((WORDS, True), (str(tmp_path / "cased.json"), False)):
        t, e = Tokenizer.from_file(path), H.WordEncoder(path)
        ids, n = e.encode(pa.array(texts))
        assert e.words == by_word
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts]


@pytest.mark.parametrize("n,limit", [(1, 20), (2, 20), (300, 9), (5000, 20), (40, 6)])
def test_code_lengths(n, limit):
    counts = np.zeros(n + 7, np.int64)
    counts[3 : 3 + n] = np.random.default_rng(n).geometric(0.001, n) ** 2
    lengths = H.code_lengths(counts, limit)
    assert (lengths > 0).sum() == n and lengths.max() <= limit
    if n > 1:
        assert sum(2.0 ** -int(x) for x in lengths if x) == 1
    codes, dice = H.canonical_codes(lengths), np.random.default_rng(1)
    ids = dice.choice(np.flatnonzero(counts), 3000).astype(np.uint32)
    data, starts = H.pack(ids, codes, lengths)
    sizes = np.diff(np.append(np.arange(0, 3000, H.STEP), 3000))
    assert (H.decode_blocks(data, starts, sizes, H.decode_table(lengths)) == ids).all()
    assert (H.decode_blocks(data, starts[2:3], sizes[2:3], H.decode_table(lengths)) == ids[2 * H.STEP : 3 * H.STEP]).all()


def test_limited_lengths_are_optimal():
    def best(counts, limit):
        from functools import cache

        n, s = len(counts), sorted(counts, reverse=True)

        @cache
        def cost(i, least, room):  # room in units of 2^-limit
            if i == n:
                return 0 if room >= 0 else 10**9
            return min((s[i] * k + cost(i + 1, k, room - (1 << limit - k)) for k in range(least, limit + 1) if room >= 1 << limit - k), default=10**9)

        return cost(0, 1, 1 << limit)

    for seed in range(8):
        counts = np.random.default_rng(seed).integers(1, 100, 7) ** 2
        assert int((H.code_lengths(counts, 4) * counts).sum()) == best(counts.tolist(), 4)


@pytest.fixture(scope="module")
def v():
    return B.Vocabulary(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def tik(v):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})


def test_bpe_query(spark, odd_docs, odd_rows, no_docs, tik):
    got = B.coded(odd_docs, RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    want = []
    for i, x in odd_rows:
        ids = tik.encode_ordinary(x or "")
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((x or "").encode()).hexdigest(), ids))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got) == sorted(want)
    assert B.coded(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("stretch", [B.STRETCH, 40, 9])
def test_bpe_texts(monkeypatch, v, tik, stretch):
    """All white space of a third of the texts, ASCII white space in the others; stretches end within texts."""
    monkeypatch.setattr(B, "STRETCH", stretch)
    dice, letters, wide = random.Random(1), " \n\t\x1caab'sétß12中🙂́.,  llreAKIÀ×ȺΣ", "\x85\xa0\u3000  "
    texts = ["".join(dice.choice(letters + (wide if i % 3 == 0 else "")) for _ in range(dice.randrange(60))) for i in range(1500)]
    texts += ["", None, " ", "a  ", "\n\n a", "中" * 300, "word " * 30, "it's we'll 's"]
    ids, n = B.encode(v, pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tik.encode_ordinary(t or "") for t in texts]
    assert B.encode(v, pa.array([], pa.string()))[0].tolist() == []


def test_bpe_small_memories_and_other_patterns(monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED_MATCHES", 20)
    monkeypatch.setattr(B, "REMEMBERED_WORDS", 3)
    texts = [f"word{i % 7} Other{'x' * (i % 90)} more, {i}" for i in range(100)]
    for pattern in (public_tokenizers.PATTERN, r"[0-9]|[^0-9]+"):
        v = B.Vocabulary(RANKS, pattern)
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=v.ranks, special_tokens={})
        ids, n = B.encode(v, pa.array(texts))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [own.encode_ordinary(t) for t in texts]


def test_bpe_prefixes(v, tik):
    dice = random.Random(2)
    for _ in range(150):
        x = bytes(dice.choice(b"aab theerin") for _ in range(1 + dice.randrange(70)))
        p = B.Prefixes(v, x)
        for k in range(1, len(x) + 1):
            assert p.ids(k) == tik._encode_single_piece(x[:k])
        a, b = sorted((dice.randrange(len(x)), dice.randrange(len(x))))
        p.replace(a, b, b"xyz")
        assert p.ids() == tik._encode_single_piece(x[:a] + b"xyz" + x[b:])
        assert p.last == B.Prefixes(v, p.data).last
        p.append(b"ing")
        assert p.ids() == tik._encode_single_piece(x[:a] + b"xyz" + x[b:] + b"ing")


def test_bpe_edits_stop_early(v):
    """States after an edit are found only until they agree with the old ones."""
    x = b"the quick brown fox jumps over the lazy dog again and again " * 4000
    p = B.Prefixes(v, x)
    for begin, end, by in ((5, 6, b"Q"), (100_000, 100_003, b""), (100_000, 100_000, b"new words"), (0, 0, b""), (len(x) - 1, len(x) + 5, b"!")):
        found = p.replace(begin, end, by)
        assert found <= len(by) + 4 * v.longest
        x = p.data
        assert p.last == B.Prefixes(v, x).last


def test_token_counts(spark, odd_docs, odd_rows, no_docs):
    scores = U.piece_scores(PIECES)
    by_byte = min(scores.values()) - 1_000_000

    def pieces(w):
        best = [(0, 0)]
        for end in range(1, len(w) + 1):
            found = [(best[i][0] + scores[w[i:end]], best[i][1] - 1) for i in range(max(0, end - 40), end) if w[i:end] in scores]
            if w[end - 1] not in scores:
                n = len(w[end - 1].encode())
                found.append((best[end - 1][0] + n * by_byte, best[end - 1][1] - n))
            best.append(max(found))
        return -best[-1][1]

    want = sorted((-1 if i is None else i, len((x or "").split()), sum(pieces("▁" + w) for w in (x or "").split())) for i, x in odd_rows)
    got = U.token_counts(odd_docs, PIECES).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_pretokens, r.n_tokens) for r in got) == want
    assert U.token_counts(no_docs, PIECES).count() == 0
    t = U.Trie(scores)
    t.insert("▁walking")
    before = len(t.score)
    t.insert("▁walked")
    assert len(t.score) == before + 2  # the shared prefix isn't computed again
