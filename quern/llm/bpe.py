"""Byte-pair encoding and decoding with a public vocabulary, by a dynamic programme over prefixes.

A text is cut at special tokens, then into pieces (words, numbers, marks, white space) as the tokenizer's file
asks for; pieces are encoded on their own. For every prefix of a piece the last token of its encoding is unique: it is the token that
ends the prefix and is compatible with the last token of the prefix before it. An automaton of the
vocabulary's suffixes (``Automaton``) has, after every byte, the longest token that ends there and links to the shorter ones,
so it yields the candidates of all prefixes in one pass; the compatible one is stored, and back-pointers
from the whole piece give its ids. No merge queue is run. Short pieces that weren't met before are worked through together, a step for
each length of prefix (``Encoder.together``), longer ones by themselves (``Encoder.by_prefix``).

Two tokens are compatible if encoding them side by side leaves them as they are: no merge over their border comes
before the merges that made them. Taking back those merges, the latest first, the two tokens that
touch the border are known at all times, so the test walks down two chains (``Vocabulary.compatible``). Tokens that their own bytes
don't encode to are never candidates.

Letters, numbers and white space beyond ASCII are what the tokenizers library's tables say: a
character is asked for when a worker meets it first; where the pattern's tables say otherwise, a character of
the right class stands for it when pieces are cut.

The vocabulary (bounded by its file) is read on the driver, from a path that is a parameter, and broadcast; each Python
worker builds its automaton once. Pieces and pairs met before are kept in tables of bounded size. Nothing is
shuffled. The work is linear in a text for tokens of bounded length.

Defined results: a null text is an empty one and has no tokens; texts are encoded whole, however long, without cuts or padding; rows that repeat
are encoded each; ids outside the vocabulary are left out when decoding, null ids decode to an empty text, and bytes that aren't
UTF-8 decode to U+FFFD; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import python_workers

KEPT_PIECES = 250_000
STEP_PIECES = 5_000
PAIR_BITS = 20
KEPT_LENGTH = 48

# Fixed value: the byte-level pattern of pieces.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for ASCII, where the standard library's matcher is quicker.
ASCII_PIECE = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: What stands for a letter (in no contraction), a number, white space other than a blank, and any other character.
LETTER, NUMBER, SPACE, OTHER = "x", "1", "\t", "!"


def byte_characters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write bytes with: themselves if printable, else from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Token bytes, the two tokens that each was merged from (itself twice: a byte), merge ranks and special tokens."""

    def __init__(self, file: str) -> None:
        told = json.loads(file)
        model, cutting = told["model"], told["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and cutting.get("type") == "ByteLevel" and cutting.get("use_regex") and not cutting.get("add_prefix_space") and told["normalizer"] is None
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if not plain or odd:
            raise ValueError(f"not a plain byte-level vocabulary: {odd or cutting}")
        of = byte_characters()
        ids = model["vocab"]
        self.bytes: dict[int, bytes] = {i: bytes(of[c] for c in t) for t, i in ids.items()}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: (left, right, rank)
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}  # pair: (rank, token)
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, made = ids[a], ids[b], ids[a + b]
            lower = all(x not in self.parts or self.parts[x][2] < rank for x in (left, right))
            if made in self.parts or not lower or any(len(x) > 1 and y not in self.parts for x, y in ((a, left), (b, right))):
                raise ValueError(f"merge {rank} is not of two tokens made before it")
            self.parts[made] = (left, right, rank)
            self.ranks[left, right] = (rank, made)
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"]):
            raise ValueError("special tokens that strip or stand as words aren't known")
        self.bytes |= {i: t.encode() for t, i in self.special.items()}

    def compatible(self, left: int, right: int, below: int | None = None) -> bool:
        """Whether no merge over the border of two tokens comes before those that made them, or before rank ``below``.

        Merges of a rank go from left to right: one over the border comes before one of that rank
        to its right, but not before one to its left.
        """
        parts, ranks = self.parts, self.ranks
        last = len(ranks) if below is None else below  # merges over the border of rank < last come first
        while True:
            over = ranks.get((left, right))
            if over is not None and over[0] < last:
                return False
            a, b = parts.get(left), parts.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[2] > b[2]):
                left, last = a[1], a[2]
            else:
                right, last = b[0], b[2] + 1

    def reachable(self) -> set[int]:
        """Tokens that their own bytes encode to."""
        found = {i for i, b in self.bytes.items() if i not in self.parts and len(b) == 1}
        for token, (left, right, rank) in self.parts.items():  # in order of rank
            if left in found and right in found and self.compatible(left, right, rank):
                found.add(token)
        return found


class Automaton:
    """After any bytes, the state is the longest end of them that begins a token.

    ``longest`` has the longest token that ends there, ``shorter`` the next token that ends where a token does. Only states with
    children have a row of steps; the others step as the state of their next shorter end.
    """

    def __init__(self, tokens: dict[int, bytes]) -> None:
        children: list[dict[int, int]] = [{}]
        ending = [-1]
        for token, text in tokens.items():
            state = 0
            for b in text:
                state = children[state].setdefault(b, len(children))
                if state == len(children):
                    children.append({})
                    ending.append(-1)
            ending[state] = token
        n = len(children)
        fail, row, longest = array("i", bytes(4 * n)), array("i", bytes(4 * n)), ending[:]
        self.shorter = np.full(max(tokens) + 1, -1, np.int32)
        steps = np.zeros((1 + sum(map(bool, children[1:])), 256), np.int32)
        queue, met = array("i", [0]), 0
        for state in queue:
            end, below = fail[state], children[state]
            children[state] = {}
            if state and ending[state] < 0:
                longest[state] = longest[end]
            elif state:
                self.shorter[ending[state]] = longest[end]
            row[state] = row[end]
            if not below:
                continue
            if state:
                met += 1
                steps[met] = steps[row[end]]
                row[state] = met
            own = steps[row[state]]
            for b, child in below.items():
                fail[child] = int(own[b]) if state else 0
                own[b] = child
                queue.append(child)
        self.step = steps.reshape(-1)
        self.row = np.array(row, np.int32) * 256
        self.longest = np.array(longest, np.int32)


class Encoder(dict):
    """The ids of a piece as the bytes of 32-bit numbers (a dictionary that works out what it lacks), and those of whole texts."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.words = vocabulary
        specials = set(vocabulary.special.values())
        self.automaton = Automaton({t: vocabulary.bytes[t] for t in sorted(vocabulary.reachable() - specials)})
        self.sizes = np.zeros(max(vocabulary.bytes) + 1, np.int64)
        self.sizes[list(vocabulary.bytes)] = list(map(len, vocabulary.bytes.values()))
        self.pairs, self.fit = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.special = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.met = set(map(chr, range(128)))
        self.stands: dict[int, str] = {}  # characters that the library's tables see otherwise than the pattern's

    def __missing__(self, piece: str) -> bytes:
        ids = np.int32([self.words.special[piece]]).tobytes() if piece in self.words.special else self.by_prefix(piece.encode())
        return self.keep({piece: ids})[piece]

    def keep(self, found: dict[str, bytes]) -> dict[str, bytes]:
        if len(self) + len(found) > KEPT_PIECES:
            self.clear()
        self.update((p, ids) for p, ids in found.items() if len(p) <= KEPT_LENGTH)
        return found

    def fits(self, keys: np.ndarray) -> np.ndarray:
        """Whether pairs (left token * 2**32 + right token) are compatible; a table of fixed size keeps those met last."""
        slot = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out, new = self.fit[slot], np.flatnonzero(self.pairs[slot] != keys)
        if len(new):
            pairs, at = np.unique(keys[new], return_inverse=True)
            found = np.array([self.words.compatible(k >> 32, k & 0xFFFFFFFF) for k in pairs.tolist()])[at]
            out[new] = found
            slot = slot[new]
            self.pairs[slot] = keys[new]
            self.fit[slot] = found
            odd = self.pairs[slot] != keys[new]  # several pairs of one slot: none of them is kept
            self.pairs[slot[odd]] = -1
        return out

    def by_prefix(self, raw: bytes) -> bytes:
        """The last token of every prefix of a piece, then the back-pointers from the whole."""
        of = self.automaton
        step, row, longest, shorter, sizes = map(memoryview, (of.step, of.row, of.longest, of.shorter, self.sizes))
        last, known = array("i", bytes(4 * len(raw) + 4)), {}
        state = 0
        for at, b in enumerate(raw, 1):
            state = step[row[state] + b]
            token = longest[state]
            while (start := at - sizes[token]) > 0:
                key = last[start] << 32 | token
                fits = known.get(key)
                if fits is None:
                    if len(known) >= 1 << PAIR_BITS:
                        known.clear()
                    fits = known[key] = self.words.compatible(last[start], token)
                if fits:
                    break
                token = shorter[token]
            last[at] = token
        out, end = array("i"), len(raw)
        while end:
            out.append(last[end])
            end -= sizes[last[end]]
        return out[::-1].tobytes()

    def together(self, pieces: list[str]) -> dict[str, bytes]:
        """The same for short pieces in order of their bytes' number: prefixes of one length of all of them in a step."""
        of, raws = self.automaton, [p.encode() for p in pieces]
        size = np.array(list(map(len, raws)))
        longest = int(size[-1])
        text = np.frombuffer(b"".join(r.ljust(longest, b"\0") for r in raws), np.uint8).reshape(len(raws), longest)
        last = np.full((len(raws), longest + 1), -1)
        state = np.zeros(len(raws), np.int32)
        for at in range(longest):
            low = np.searchsorted(size, at, "right")  # pieces with a byte there
            rows = np.arange(low, len(raws))
            state[low:] = of.step[of.row[state[low:]] + text[low:, at]]
            token = of.longest[state[low:]].astype(np.int64)
            while len(rows):
                before = last[rows, at + 1 - self.sizes[token]]
                fits = before < 0  # the prefix is a token
                rest = np.flatnonzero(~fits)
                fits[rest] = self.fits(before[rest] << 32 | token[rest])
                last[rows[fits], at + 1] = token[fits]
                rows, token = rows[~fits], of.shorter[token[~fits]].astype(np.int64)
        at, columns = size.copy(), []
        while (now := last[np.arange(len(raws)), at]).max() >= 0:
            columns.append(now)
            at -= np.where(now >= 0, self.sizes[now], 0)
        back = np.array(columns[::-1], np.int32)
        flat, counts = back.T[(back >= 0).T].tobytes(), (back >= 0).sum(0)
        ends = (4 * np.cumsum(counts)).tolist()
        return {p: flat[low:high] for p, low, high in zip(pieces, [0, *ends], ends, strict=False)}

    def learn(self, characters: set[str]) -> None:
        """Ask the library for the classes of characters that weren't met before; those that the pattern sees otherwise get a stand-in."""
        from tokenizers.pre_tokenizers import ByteLevel

        library = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        for c in characters:
            kinds = [next((kind for kind in (LETTER, NUMBER, OTHER) if len(cut(kind + c)) == 1), SPACE) for cut in (library, PIECE.findall)]
            if kinds[0] != kinds[1]:
                self.stands[ord(c)] = kinds[0]
        self.met |= characters

    def plain_pieces(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_PIECE.findall(text)
        here = set(text)
        if new := here - self.met:
            self.learn(new)
        if not self.stands or self.stands.keys().isdisjoint(map(ord, here)):
            return PIECE.findall(text)
        return [text[m.start() : m.end()] for m in PIECE.finditer(text.translate(self.stands))]

    def pieces(self, text: str) -> list[str]:
        """Special tokens and, between them, the pieces of the text."""
        out, at = [], 0
        for m in self.special.finditer(text) if self.special else ():
            out += [*self.plain_pieces(text[at : m.start()]), m.group()]
            at = m.end()
        return out + self.plain_pieces(text[at:]) if at else self.plain_pieces(text)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.pieces(t) for t in texts]
        new = set().union(*cut) - self.keys() - self.words.special.keys()
        short = sorted((p for p in new if len(p) <= KEPT_LENGTH), key=lambda p: len(p.encode()))
        for low in range(0, len(short), STEP_PIECES):
            self.keep(self.together(short[low : low + STEP_PIECES]))
        return [np.frombuffer(b"".join(map(self.__getitem__, pieces)), np.int32) for pieces in cut]


_ENCODERS: dict[int, tuple[Vocabulary, Encoder]] = {}


def encoder(vocabulary: Vocabulary) -> Encoder:
    """This worker's encoder of a vocabulary; the last one is kept."""
    if id(vocabulary) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[id(vocabulary)] = vocabulary, Encoder(vocabulary)
    return _ENCODERS[id(vocabulary)][1]


def load(path: str) -> Vocabulary:
    with open(path, encoding="utf-8") as file:
        return Vocabulary(file.read())


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id and the ids of its whole text."""
    python_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(load(path))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoder(shared.value)
        for batch in batches:
            ids = of.encode(batch.column("text").to_pylist())
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, flat)], ["doc_id", "ids"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) and the text that the ids stand for."""
    python_workers(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(load(path).bytes)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            ids = batch.column("ids")
            parts = [of.get(i, b"") for i in ids.flatten().to_numpy(zero_copy_only=False).tolist()]
            ends = np.cumsum(ids.value_lengths().fill_null(0).to_numpy()).tolist()
            texts = [b"".join(parts[low:high]).decode("utf-8", "replace") for low, high in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Per row: the number of tokens, and the digests of the ids and of the text decoded from them."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decoded(encoded(docs, path), path).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )
