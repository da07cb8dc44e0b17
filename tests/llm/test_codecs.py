"""Parts without Spark: the prefix encoder, the range coder, suffix arrays, hashes and nearest codes, against plain versions."""

import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from repograph.llm import bpe, hamming, hashing, jaccard, rangecoder, suffixes, tokenfiles


@pytest.fixture(scope="module")
def encoder():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.PrefixEncoder(bpe.read_ranks(f.read()))


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=60))
def test_bpe_equals_the_library(encoder, reference, text):
    text = text.encode("utf-8", "ignore").decode()
    ids = [i for piece in bpe.Splitter()(text) for i in encoder.encode(piece.encode())]
    assert ids == reference.encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


def test_bpe_appends_and_edits(encoder):
    rng = random.Random(5)
    for _ in range(200):
        piece = bytes(rng.choices(b"abcthe ing", k=rng.randint(1, 60)))
        last = encoder.prefixes(piece)
        more = bytes(rng.choices(b"xyer", k=rng.randint(0, 9)))
        assert encoder.appended(piece, last, more) == (piece + more, encoder.prefixes(piece + more))
        start = rng.randint(0, len(piece))
        end = rng.randint(start, len(piece))
        assert encoder.edited(piece, last, start, end, more) == (piece[:start] + more + piece[end:], encoder.prefixes(piece[:start] + more + piece[end:]))


@settings(max_examples=40, deadline=None)
@given(blocks=st.lists(st.lists(st.integers(0, 49407), max_size=80), max_size=6))
def test_range_coder_round_trip(blocks):
    coded = rangecoder.encode([np.array(b, dtype=np.int64) for b in blocks], 49408)
    assert [list(map(int, b)) for b in rangecoder.decode(coded)] == blocks


def test_range_coder_long_runs_and_damage():
    blocks = [np.array([7] * 6000), np.arange(6000) % 5]
    coded = rangecoder.encode(blocks, 49408)
    assert sum(map(len, coded)) < 1000
    assert all((a == b).all() for a, b in zip(blocks, rangecoder.decode(coded), strict=True))
    broken = bytearray(coded[1])
    broken[len(broken) // 2] ^= 255
    with pytest.raises(ValueError):
        rangecoder.decode([bytes(broken)])


def test_range_coder_of_several_vocabularies():
    rng = np.random.default_rng(8)
    blocks = [(rng.integers(0, v, n), v) for v in (1, 2, 255, 300, 49408, 65536) for n in (0, 1, 5, 63, 64, 200, 700)]
    coded = [rangecoder.encode([b], v)[0] for b, v in blocks]
    assert all((a == b).all() for (a, _), b in zip(blocks, rangecoder.decode(coded), strict=True))
    together = rangecoder.encode([b for b, _ in blocks], 65536)
    assert all((a == b).all() for (a, _), b in zip(blocks, rangecoder.decode(together), strict=True))


def test_range_coder_damage_anywhere_is_told():
    rng = np.random.default_rng(9)
    blocks = [rng.integers(0, 49408, 70), np.arange(1100) % 7 * 5000, np.zeros(3, dtype=int)]
    for block, coded in zip(blocks, rangecoder.encode(blocks, 49408), strict=True):
        for at in range(6 + 12, len(coded), 1 + len(coded) // 40):
            broken = bytearray(coded)
            broken[at] ^= 1 << at % 8
            try:
                # The last bits of a block may say nothing.
                assert (rangecoder.decode([bytes(broken)])[0] == block).all() and at >= len(coded) - 9
            except ValueError:
                pass


def test_word_encoder_asks_for_each_piece_once():
    """Words that differ in capitals and signs only are one piece for the library."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = tokenfiles.WordEncoder(f.read())
    encoder.clear()
    encoder.encode(["Zérox, zÉrox. (ZÉROX) zérox11", "zérox's"])
    assert set(encoder) == {"zérox", ",", ".", "(", ")", "1", "zérox's"}


def test_word_encoder_of_texts_longer_than_a_step(monkeypatch):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = f.read()
    library, encoder = Tokenizer.from_str(vocabulary), tokenfiles.WordEncoder(vocabulary)
    monkeypatch.setattr(tokenfiles, "TOGETHER", 100)
    atoms = [*"abZÉßÿ×÷ãñ019.,!'-_(<|>\\\x7f\x00\x0b\x1c\x85\xa0\xad\xb5\xb2\u20ac\u4e2d\u03a3\u0130\u0301 \t\n\r", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "the", "a" * 70, " ", " ", " "]
    rng = random.Random(5)
    for _ in range(300):
        texts = ["".join(rng.choices(atoms, k=rng.randint(0, 60))) for _ in range(rng.randint(1, 9))]
        texts[rng.randrange(len(texts))] = rng.choice([None, "", "x" * 250])
        found, ended = [[] for _ in texts], [0] * len(texts)
        for i, ids, ends in encoder.pieces(pa.array(texts, pa.string())):
            found[i] += ids.tolist()
            ended[i] += ends
        assert found == [library.encode(t or "", add_special_tokens=False).ids for t in texts] and set(ended) == {1}


def test_word_encoder_equals_the_library():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        encoder = tokenfiles.WordEncoder(f.read())
    for text in ("", " a  b\n", "It's 42 Éléphants… don't!\x1c!", "a<|endoftext|>b", "é ́x  y z", "ΑΣ Σ"):
        for _ in range(2):
            assert list(np.frombuffer(encoder.encode([text, "other"])[0], dtype="<u2")) == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(pieces=st.lists(st.binary(max_size=30).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=6), length=st.integers(2, 8))
def test_repeated_starts(pieces, length):
    count = Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
    expected = [i + length <= len(p) and count[p[i : i + length]] > 1 for p in pieces for i in range(len(p) + 1)]
    assert list(suffixes.repeated_starts(pieces, length)) == expected


def test_repeated_starts_of_longer_pieces():
    rng = random.Random(11)
    for length in (5, 40, 200):
        base = bytes(rng.choices(b"ab", k=900))
        pieces = [base[rng.randint(0, 300) : rng.randint(500, 900)] + bytes(rng.choices(b"abc", k=rng.randint(0, 90))) for _ in range(12)] + [b"a" * 700, b"", b"b" * 150]
        count = Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
        expected = [i + length <= len(p) and count[p[i : i + length]] > 1 for p in pieces for i in range(len(p) + 1)]
        assert list(suffixes.repeated_starts(pieces, length)) == expected


def test_repeated_starts_of_weighted_pieces():
    rng = random.Random(12)
    for length in (2, 5, 40):
        pieces = [bytes(rng.choices(b"ab", k=rng.choice([0, 3, 30, 80]))) for _ in range(8)]
        several = np.array([rng.random() < 0.4 for _ in pieces])
        both = suffixes.repeated_starts(pieces + [p for p, s in zip(pieces, several, strict=True) if s], length)
        assert list(suffixes.repeated_starts(pieces, length, several)) == list(both[: sum(len(p) + 1 for p in pieces)])


def test_runs_cover_every_window_once():
    texts = [bytes(random.Random(i).choices(b"ab cd", k=n)) for i, n in enumerate((0, 30, 700, 60, 900))]
    seen = Counter()
    for text, _, _, low, n, _ in suffixes.runs(texts, 60):
        for t, a, k in zip(text, low, n, strict=True):
            seen.update((int(t), int(a) + i) for i in range(k))
    assert seen == Counter((t, i) for t, x in enumerate(texts) for i in range(len(x) - 59))


def test_shingles_equal_sets_of_words():
    texts = [b"", b" \t", b"A b", b"a B", b"a b c d a b c", b"x  a\nb c d a b c y"]
    sets = [set(map(int, s)) for s in hashing.shingle_sets(texts, 3)]
    assert [len(s) for s in sets] == [0, 0, 1, 1, 4, 6]
    assert sets[2] == sets[3] and len(sets[4] & sets[5]) == 4


def test_linked_sets_share_a_tile():
    rng = np.random.default_rng(3)
    for _ in range(300):
        percent, n = int(rng.choice([80, 90])), int(rng.integers(5, 120))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        b = np.unique(np.concatenate([rng.permutation(a)[: len(a) - int(rng.integers(0, n // 5 + 1))], rng.integers(0, 1 << 63, int(rng.integers(0, n // 6 + 1)), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= percent * (len(a) + len(b) - both) and both < max(len(a), len(b)):
            assert set(jaccard.segment_keys(a, percent)) & set(jaccard.segment_keys(b, percent))
            bits = jaccard._folded([jaccard.parity_bitmap(x, percent) for x in (a, b)])
            assert jaccard.bound_on_difference(bits[0], bits[1:])[0] <= len(a) + len(b) - 2 * both


def test_nearest_codes():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 1 << 63, 400, dtype=np.uint64) & np.uint64(0xFFFF00FF00FF0FFF)
    codes[50:120] = codes[3]
    block = hamming.Block(codes, np.arange(400))
    for q in (0, 3, 77, 399):
        expected = sorted((int(np.bitwise_count(codes[i] ^ codes[q])), i) for i in range(400))[:10]
        assert block.nearest(codes[q], 10) == expected
    assert len(block.nearest(codes[0], 1000)) == 400


def test_long_words_that_share_sums_are_told_apart():
    """The Thue-Morse word of 1024 letters and its complement have the same sum modulo 2**64 for every odd base."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    texts = [word.encode(), word.translate(str.maketrans("ab", "ba")).encode()]
    hashes, _ = hashing.word_hashes(texts)
    assert hashes[0] != hashes[1] and hashing.word_hashes([texts[0].upper()])[0][0] == hashes[0]
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    both = hashing.long_stretches(raw, *hashing.byte_sums(raw), np.array([0, 1024]), np.array([1024, 2048]))
    assert both[0] != both[1]


def test_tokenizers_that_files_cannot_hold():
    wide = json.loads(open(public_tokenizers.path("word_bpe_49k.json")).read())
    n = len(wide["model"]["vocab"])
    wide["model"]["vocab"] |= {f"\u4e00{i}": n + i for i in range(20_000)}
    with pytest.raises(ValueError, match="16 bits"):
        tokenfiles.WordEncoder(json.dumps(wide))
    with pytest.raises(ValueError, match="one after another"):
        tokenfiles.WordEncoder(open(public_tokenizers.path("byte_bpe_50k.json")).read())
