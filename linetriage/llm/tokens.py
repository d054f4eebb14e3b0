"""Token ids of whole texts by a word-level tokenizer file, with a bounded memory of words."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

END_ID = 2
# Latin letters that are one letter before and after lower-casing and composition.
_LETTERS = "A-Za-zÀ-ÖØ-öø-į"
_SAMPLES = ("a", "Word", "end.", "(ÀÉî,", "x2y34", "foo_bar/-baz;", "Straße", "100%", "e.g.", "#!", "ĀāĮį")
_PIECE = re.compile(f"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
STRETCH = 1 << 18  # bytes of texts looked at together, at least
_SPACE, _LETTER, _DIGIT, _SIGN, _ODD, _NEXT = range(6)
_U = np.uint64


def _kinds() -> np.ndarray:
    """The kind of each byte of UTF-8; what follows a first byte is looked at with it."""
    kinds = np.full(256, _ODD, np.uint8)
    kinds[0x21:0x7F] = _SIGN
    kinds[[0x20, 0x0A]] = _SPACE
    kinds[0x27] = _ODD
    for letters in (slice(0x41, 0x5B), slice(0x61, 0x7B), slice(0xC3, 0xC5)):
        kinds[letters] = _LETTER
    kinds[0x30:0x3A] = _DIGIT
    kinds[0x80:0xC0] = _NEXT
    return kinds


_KINDS = _kinds()
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)  # masks of the first bytes of 8


class Pieces:
    """Where the ids of pieces of at most 16 bytes lie: a hash table in arrays that holds the pieces themselves."""

    def __init__(self) -> None:
        self.count = 0
        self.room(1 << 10)

    def room(self, size: int) -> None:
        self.keys, self.at = np.zeros((size, 2), _U), np.zeros((size, 2), np.int32)
        self.shift = _U(64 - (size.bit_length() - 1))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[:, 0] * _U(0x9E3779B97F4A7C15) + (keys[:, 1] ^ (keys[:, 0] >> _U(29))) * _U(0xD6E8FEB86659FD93)
        return (((mixed ^ (mixed >> _U(32))) * _U(0xBF58476D1CE4E5B9)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is not held."""
        slot, last = self.slots(keys), len(self.keys) - 1
        held = self.keys[slot]
        same = (held[:, 0] == keys[:, 0]) & (held[:, 1] == keys[:, 1])
        others = np.flatnonzero(~same)
        slot[others[held[others, 0] == 0]] = -1
        others = others[held[others, 0] != 0]
        while len(others):
            slot[others] = (slot[others] + 1) & last
            held, wanted = self.keys[slot[others]], keys[others]
            empty = held[:, 0] == 0
            slot[others[empty]] = -1
            others = others[~empty & ((held[:, 0] != wanted[:, 0]) | (held[:, 1] != wanted[:, 1]))]
        return slot

    def add(self, keys: np.ndarray, at: np.ndarray) -> bool:
        """Hold different keys that are not held yet; True if that moved the others."""
        moved = 2 * (self.count + len(keys)) > len(self.keys)
        if moved:
            used = self.keys[:, 0] != 0
            keys, at = np.concatenate([self.keys[used], keys]), np.concatenate([self.at[used], at])
            self.room(1 << (2 * len(keys)).bit_length())
            self.count = 0
        self.count += len(keys)
        slot, last = self.slots(keys), len(self.keys) - 1
        while len(keys):
            free = np.flatnonzero(self.keys[slot, 0] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.at[slot[put]] = keys[put], at[put]
            left = np.ones(len(keys), bool)
            left[put] = False
            keys, at, slot = keys[left], at[left], (slot[left] + 1) & last
        return moved


class WordEncoder:
    """``Tokenizer.encode(text, add_special_tokens=False)`` for many texts that share words.

    The tokenizer drops white space and never joins what stands on both sides of it, so the ids of a
    text are those of its space-separated words in turn. Words of plain letters, digits and signs are
    cut into pieces here, many texts at once by the kinds of their bytes; a piece is encoded once and found
    again by its bytes. Samples show whether the file follows the rules known here, and all other words go
    through the whole library. At most ``limit`` of these and four times as many pieces, which take 50 to 100
    bytes each, are remembered per Python worker, besides those of one stretch of texts.
    """

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.forget()
        size = self.tokenizer.get_vocab_size()
        if size > 1 << 16:
            raise ValueError("ids of this tokenizer need more than 16 bits")
        self.model = self.tokenizer.model
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in plain]
        self.letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        self.direct = all(self.pieced(w) == self.one(w) for w in _SAMPLES)

    def forget(self) -> None:
        """``memory`` and ``pieces`` say where in ``ids`` the ids of a word or piece start, and how many they are."""
        self.memory: dict[bytes, tuple[int, int]] = {}
        self.pieces = Pieces()
        self.ids, self.used = np.empty(1 << 12, "<u2"), 0

    def one(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def piece(self, lower: bytes) -> list[int]:
        """Ids of one piece straight from the merges."""
        return [t.id for t in self.model.tokenize(lower.decode("latin-1").translate(self.letters))]

    def pieced(self, word: str) -> list[int]:
        """Ids of a word of plain characters: lower-cased, cut into pieces as the tokenizer's pattern does."""
        return [i for p in _PIECE.findall(word.lower()) for i in self.piece(p.encode())]

    def keep(self, found: list[list[int]]) -> np.ndarray:
        """Store the ids of words or pieces; where each starts and how many there are."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ends = self.used + np.cumsum(sizes)
        if len(found) and ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), int(ends[-1]) - len(self.ids)), "<u2")])
        if len(found):
            self.ids[self.used : ends[-1]] = [i for ids in found for i in ids]
            self.used = int(ends[-1])
        return np.stack([ends - sizes, sizes], 1).astype(np.int32)

    def kinds(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kind of each byte, all bytes of a word that is not plain being odd, and the bytes lower-cased."""
        kind, lower = _KINDS.take(raw), _LOWER.take(raw)
        after = np.flatnonzero(kind == _NEXT)
        if len(after):
            first, second = raw[after - 1], raw[after]
            c3, c4 = (first == 0xC3) & (second != 0x97) & (second != 0xB7), (first == 0xC4) & (second < 0xB0)
            kind[after] = np.where(c3 | c4, _LETTER, _ODD)
            lower[after] = second + 32 * (c3 & (second < 0x9F)).astype(np.uint8) + (c4 & (second % 2 == 0))
        kind[np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))] = _ODD
        if not self.direct:
            kind[kind != _SPACE] = _ODD
            return kind, lower
        odd = np.flatnonzero(kind == _ODD)
        if len(odd):
            gaps = np.flatnonzero(kind == _SPACE)
            for word in np.unique(np.searchsorted(gaps, odd)).tolist():
                kind[gaps[word - 1] + 1 : gaps[word]] = _ODD
        return kind, lower

    def stretch(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places of the pieces in ``data``, ids up to the end of each, ids); a space or line end stands first and last."""
        if len(self.memory) > self.limit or self.pieces.count > 4 * self.limit:
            self.forget()
        raw = np.frombuffer(data, np.uint8)
        kind, lower = self.kinds(raw)
        new = kind[1:] != kind[:-1]
        new |= kind[1:] == _DIGIT
        starts = np.flatnonzero(new) + 1
        sizes = np.diff(starts, append=len(raw))
        of = kind.take(starts)
        some = np.flatnonzero(of != _SPACE)
        starts, sizes, of = starts[some], sizes[some], of[some]
        by_hand = (of == _ODD) | (sizes > 16)
        padded = np.concatenate([lower, np.zeros(16, np.uint8)])
        keys = np.ndarray(len(raw), "V16", padded.data, strides=(1,))[starts].view("<u8").reshape(-1, 2)
        keys[:, 0] &= _FIRST.take(np.minimum(sizes, 8))
        keys[:, 1] &= _FIRST.take(np.clip(sizes - 8, 0, 8))
        place = self.pieces.find(keys)
        unknown = np.flatnonzero((place < 0) & ~by_hand)
        if len(unknown):
            text = lower.tobytes()
            cuts = zip(starts[unknown].tolist(), (starts + sizes)[unknown].tolist())
            learnt = {text[a:b]: i for i, (a, b) in zip(unknown.tolist(), cuts)}
            moved = self.pieces.add(keys[list(learnt.values())], self.keep([self.piece(p) for p in learnt]))
            again = slice(None) if moved else unknown
            place[again] = self.pieces.find(keys[again])
        at = self.pieces.at[place]
        for i in np.flatnonzero(by_hand).tolist():
            at[i] = self.whole(data[starts[i] : starts[i] + sizes[i]], of[i] == _ODD)
        ends = np.cumsum(at[:, 1], dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        return starts, ends, self.ids.take(np.repeat(at[:, 0] - (ends - at[:, 1]), at[:, 1]) + np.arange(total))

    def whole(self, word: bytes, odd: bool) -> tuple[int, int]:
        """Where the ids of an odd word, or of a piece too long for the table, are."""
        known = self.memory.get(word)
        if known is None:
            text = word.decode()
            ids = self.one(text) if odd else self.piece(text.lower().encode())
            known = self.memory[word] = tuple(self.keep([ids])[0].tolist())
        return known

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 16-bit integers."""
        out: list[bytes] = []
        raws = [t.encode() for t in texts]
        at = 0
        while at < len(raws):
            if len(raws[at]) > 2 * STRETCH:
                out.append(self.long(raws[at]))
                at += 1
                continue
            first, size = at, 0
            while at < len(raws) and size < STRETCH and len(raws[at]) <= 2 * STRETCH:
                size += len(raws[at]) + 1
                at += 1
            starts, ends, ids = self.stretch(b" ".join([b"", *raws[first:at], b""]))
            stops = np.cumsum([len(r) + 1 for r in raws[first:at]]) + 1
            cuts = np.concatenate([[0], ends])[np.searchsorted(starts, stops)].tolist()
            out += [ids[a:b].tobytes() for a, b in zip([0, *cuts], cuts)]
        return out

    def long(self, raw: bytes) -> bytes:
        """Ids of one long text, cut at spaces and line ends."""
        done, at, raw = [], 0, raw.replace(b"\n", b" ")
        while at < len(raw):
            end = raw.find(b" ", at + STRETCH)
            end = len(raw) if end < 0 else end
            done.append(self.stretch(b" " + raw[at:end] + b" ")[2].tobytes())
            at = end
        return b"".join(done)


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode_with_end(path: str, texts: list[str], end_id: int = END_ID) -> list[np.ndarray]:
    """Ids of each text followed by the end id."""
    tail = np.array([end_id], "<u2").tobytes()
    return [np.frombuffer(raw + tail, "<u2") for raw in word_encoder(path).encode(texts)]
