"""Vectorised byte-level BPE shared by token counting and packing: texts are split with numpy, each distinct piece is encoded once."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Pieces whose ids a worker keeps; beyond it the cache starts anew.
CACHE_PIECES = 400_000


@lru_cache(1)
def classes() -> np.ndarray:
    r"""For each code point: \p{L}, \p{N}, \s or other, as the splitting pattern sees it."""
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        for m in regex.finditer(f"{pattern}+", every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            out[a : b + 1] = kind
    return out


def starts(cps: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Flags of the code points at which the GPT-2 pattern starts a piece; first: flags of the texts' first code points."""
    kind = classes()[cps]
    new = first.copy()
    new[1:] |= kind[1:] != kind[:-1]
    inside = np.zeros(len(cps), bool)  # the next code point is of the same text
    inside[:-1] = ~first[1:]
    space = kind == SPACE
    out = new.copy()
    last = np.flatnonzero(space[:-1] & inside[:-1] & ~space[1:])
    out[last] = True  # the last white space before a word is a piece, or the start of the word's piece
    glued = cps[last] == 0x20
    out[last[glued] + 1] = False
    quote = np.flatnonzero((cps == 0x27) & new & inside)
    if len(quote):
        quote = quote[kind[quote + 1] == LETTER]
        quote = quote[first[quote] | (cps[quote - 1] != 0x20)]
        for i in quote.tolist():
            c = cps[i + 1]
            two = inside[i + 1] and chr(c) + chr(cps[i + 2]) in ("re", "ve", "ll")
            k = 1 if c in (0x73, 0x74, 0x6D, 0x64) else 2 if two else 0
            if k:
                out[i + 1] = False
                if inside[i + k]:
                    out[i + k + 1] = True
    return out


class Pieces:
    """The pieces of some texts: piece i of the distinct ones is `unique[i]`; `codes` has one for each piece, in order."""

    def __init__(self, texts: list[str]):
        joined = "".join(texts)
        data = joined.encode()
        cps = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lens)
        first = np.zeros(len(cps) + 1, bool)
        first[ends - lens] = True
        first = first[:-1]
        at = np.flatnonzero(starts(cps, first)) if len(cps) else np.zeros(0, np.int64)
        self.ends = np.searchsorted(at, ends)  # of each text: the number of pieces up to its end
        if len(data) != len(cps):
            width = 1 + (cps >= 0x80).astype(np.int8) + (cps >= 0x800) + (cps >= 0x10000)
            at = (np.cumsum(width, dtype=np.int64) - width)[at]
        length = np.diff(at, append=len(data))
        pad = data + bytes(16)
        words = np.ndarray((len(data) + 9,), "<u8", pad, strides=(1,))
        keep = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
        short = np.minimum(length, 15)
        low = words[at] & keep[np.minimum(short, 8)]
        high = words[at + 8] & keep[np.maximum(short - 8, 0)]
        high |= np.minimum(length, 16).astype(np.uint64) << np.uint64(56)
        self.codes, rep = distinct(low, high)
        long = np.flatnonzero(length > 15)
        a, b = at[rep], at[rep] + length[rep]
        self.unique = [data[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        if len(long):  # compared as bytes
            more: dict[bytes, int] = {}
            for p, i, k in zip(long.tolist(), at[long].tolist(), length[long].tolist(), strict=True):
                self.codes[p] = len(self.unique) + more.setdefault(data[i : i + k], len(more))
            self.unique += more


def distinct(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the equal (low, high), and of each code the place of its first."""
    import pandas as pd

    with np.errstate(over="ignore"):
        mixed = (low ^ (low >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) ^ (high ^ (high >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    codes, found = pd.factorize(mixed)
    rep = np.empty(len(found), np.int64)
    rep[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    same = rep[codes]
    if not (np.array_equal(low[same], low) and np.array_equal(high[same], high)):
        _, rep, codes = np.unique(np.stack([low, high], 1), axis=0, return_index=True, return_inverse=True)
        codes = codes.ravel()
    return codes.astype(np.int64), rep


class FastBPE:
    """Ids as the tokenizers library gives them for a byte-level BPE file, without added special tokens.

    Texts with a special token's string, or with code points beyond the tables both libraries agree on, go to the library itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            told = json.load(f)
        self.special = [x["content"] for x in told.get("added_tokens", [])]
        pre, model = told.get("pre_tokenizer") or {}, told["model"]
        self.plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not told.get("normalizer") and not told.get("truncation") and not told.get("padding") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        if self.plain:
            to_byte = {c: b for b, c in byte_letters().items()}
            ranks = {bytes(to_byte[c] for c in w): i for w, i in model["vocab"].items() if w not in self.special}
            self.encoding = tiktoken.Encoding("file", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, int] = {}
        self.flat, self.at = np.zeros(1 << 16, np.uint32), [0]
        self.fill = 0

    def _add(self, piece: bytes) -> int:
        ids = self.encoding._core_bpe.encode_single_piece(piece)
        if self.fill + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[self.fill : self.fill + len(ids)] = ids
        self.fill += len(ids)
        self.at.append(self.fill)
        self.known[piece] = len(self.at) - 2
        return len(self.at) - 2

    def _odd(self, text: str) -> bool:
        return not self.plain or any(s in text for s in self.special) or not text.isascii() and bool(_ODD().search(text))

    def _split(self, texts: list[str]) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        odd = {i: np.array(self.library.encode(t, add_special_tokens=False).ids, np.uint32) for i, t in enumerate(texts) if t and self._odd(t)}
        pieces = Pieces(["" if i in odd else t for i, t in enumerate(texts)])
        if len(self.known) > CACHE_PIECES:
            self.known, self.at, self.fill = {}, [0], 0
        get, add = self.known.get, self._add
        found = np.fromiter((k if (k := get(p)) is not None else add(p) for p in pieces.unique), np.int64, len(pieces.unique))
        at = np.array(self.at, np.int64)
        start = at[found][pieces.codes] if len(found) else np.zeros(0, np.int64)
        count = (at[found + 1] - at[found])[pieces.codes] if len(found) else np.zeros(0, np.int64)
        return odd, pieces.ends, start, count

    def counts(self, texts: list[str]) -> np.ndarray:
        odd, ends, _, count = self._split(texts)
        upto = np.concatenate([[0], np.cumsum(count)])[ends]
        out = np.diff(upto, prepend=0)
        for i, ids in odd.items():
            out[i] = len(ids)
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        odd, ends, start, count = self._split(texts)
        upto = np.cumsum(count)
        total = int(upto[-1]) if len(upto) else 0
        flat = self.flat[np.repeat(start - (upto - count), count) + np.arange(total)]
        cut = np.concatenate([[0], upto])[ends].tolist()
        out, before = [], 0
        for i, to in enumerate(cut):
            out.append(odd[i] if i in odd else flat[before:to])
            before = to
        return out


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes are themselves, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


@lru_cache(1)
def _ODD():
    import regex

    #: Not assigned in Unicode 12 or of classes on which the libraries' Unicode versions can differ.
    return regex.compile(r"[\p{Cn}\U00010000-\U0010FFFFᲀ-᲏Ɪ-ꟿࡰ-ࣿ]")


@lru_cache(4)
def fast(path: str) -> FastBPE:
    return FastBPE(path)
