"""Byte-pair encoding against the tokenizers library, the pair test against merging, and odd rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from quern.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.public_path()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(bpe.load(PATH))


def noise(rng: random.Random, n: int) -> str:
    wide = [*"abcdefgh ETAOIN''''  \n\t\r\x0b\x1c\x1f\x00.,!?--==__0123456789", "'s", "'re", "'S", "é", "ß", "日本", "한", "😀", "́", " ", "\u0085", " ", "　", "᠎", "٣", "Ⅷ", "²", "​", "<|endoftext|>", "<|endof", " the", "ing"]
    return "".join(rng.choice(wide) for _ in range(n))


def test_ids_equal_the_library(library, own):
    rng = random.Random(1)
    texts = [noise(rng, rng.randrange(60)) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([*range(32, 0x3000), *range(0x1F300, 0x1FAFF)])) for _ in range(30)) for _ in range(500)]
    texts += ["a" * n for n in range(1, 200)] + ["=" * n for n in range(1, 150)] + [" " * n for n in range(1, 150)]
    assert [i.tolist() for i in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    own.clear()
    for text in texts:
        ids = own.encode([text])[0].tolist()
        assert ids == library.encode(text, add_special_tokens=False).ids, text
        assert b"".join(own.words.bytes[i] for i in ids).decode() == text


def test_classes_of_all_characters_equal_the_library(library, own):
    """Every assigned or unassigned code point, side by side with letters, numbers and blanks."""
    points = [c for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000]
    step = 1500
    for low in range(0, len(points), step * 25):
        text = "".join(f"a{chr(c)}1{chr(c)} {chr(c)}  {chr(c)}'" for c in points[low : low + step])
        own.met, own.stands = set(map(chr, range(128))), {}
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_long_pieces_take_linear_time(library, own):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    assert own.encode([long])[0].tolist() == library.encode(long, add_special_tokens=False).ids
    run = "q" * 200_000
    assert own.encode([run])[0].tolist() == library.encode(run, add_special_tokens=False).ids


def merged(text: str, ranks: dict, ids: dict) -> list[int]:
    """Plain merging: the pair of lowest rank, leftmost first."""
    at = [ids[c] for c in text]
    while True:
        found = min(((ranks[p][0], i) for i, p in enumerate(zip(at, at[1:], strict=False)) if p in ranks), default=None)
        if found is None:
            return at
        i = found[1]
        at[i : i + 2] = [ranks[at[i], at[i + 1]][1]]


def test_prefix_programme_on_random_vocabularies():
    """Merges drawn at random, with tokens that their own bytes don't encode to, over all short strings."""
    import itertools
    import json

    for seed in range(30):
        rng = random.Random(seed)
        vocab = {c: i for i, c in enumerate(bpe.byte_characters())}
        tokens, merges = list("abc"), []
        while len(merges) < 9:
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                merges.append([a, b])
                tokens.append(a + b)
        file = {"model": {"type": "BPE", "vocab": vocab, "merges": merges}, "pre_tokenizer": {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}, "normalizer": None, "added_tokens": []}
        own = bpe.Encoder(bpe.Vocabulary(json.dumps(file)))
        texts = ["".join(t) for n in range(1, 8) for t in itertools.product("abc", repeat=n)]
        together = own.together(texts)  # in order of length
        for text in texts:
            want = np.int32(merged(text, own.words.ranks, vocab)).tobytes()
            assert own.by_prefix(text.encode()) == want == together[text], (merges, text)


def test_digest_of_odd_rows(docs_of, library, own):
    rng = random.Random(9)
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "same text"), (4, "same text"), (None, "no id 日本"), (5, "word " * 50_000), (6, "<|endoftext|>"), (7, noise(rng, 300))]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    got = bpe.digest(docs_of(rows).withColumnRenamed("label", "ids").withColumnRenamed("size", "n_tokens"), PATH)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert bpe.digest(docs_of([]), PATH).collect() == []


def test_decoding_of_any_ids(spark, library):
    rows = [(1, [50256, 15496]), (2, []), (3, None), (4, [200, 15496]), (5, [99999, 15496]), (6, [own for own in range(150, 256)])]
    got = {r["doc_id"]: r["text"] for r in bpe.decoded(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect()}
    assert got == {i: library.decode(ids or [], skip_special_tokens=False) for i, ids in rows}


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="plain byte-level"):
        bpe.load(bpe.public_path("word_bpe_49k.json"))
