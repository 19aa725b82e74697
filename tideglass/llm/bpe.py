"""Byte-level BPE over many texts at once: pre-tokens as spans, merges applied rank by rank on ragged numpy arrays."""

from __future__ import annotations

import json
import sys
import unicodedata

import numpy as np

from tideglass.llm.words import hashes

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: White space of the pattern's ``\s`` (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings split off after an apostrophe (fixed values), in the order in which they are tried.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Distinct pre-tokens whose ids a worker remembers; beyond that it starts anew.
REMEMBERED = 1 << 19


def _classes() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[WHITE] = SPACE
    return out


_table: np.ndarray | None = None


def classes() -> np.ndarray:
    global _table
    if _table is None:
        _table = _classes()
    return _table


def pretokens(points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens in code points, texts parted at ``cuts`` (their starts, then the end).

    The rules are those of the byte-level pattern: contractions, then an optional blank with letters, numbers or
    other characters, then white space, whose last character is left to what follows. Every code point is in one pre-token.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[cuts] = True
    begin = first[:-1].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(begin)
    ends = np.append(runs[1:], n)
    run_kind = kind[runs]
    start = begin.copy()
    # White space before other text: its last character stands apart, or leads the next pre-token if it is a blank.
    followed = (run_kind == SPACE) & ~first[ends]
    last = ends[followed] - 1
    start[last] = True
    blank = points[last] == 0x20
    start[last[blank] + 1] = False
    # Contractions: an apostrophe that begins a pre-token and is followed by one of the endings.
    quote = runs[(run_kind == OTHER) & (ends - runs == 1) & (points[runs] == 0x27)]
    quote = quote[start[quote] & ~first[quote + 1]]
    if len(quote):
        length = ends[np.searchsorted(runs, quote + 1)] - quote - 1
        room = np.pad(points, (0, 2))
        open_ = kind[np.minimum(quote + 1, n - 1)] == LETTER
        for ending in CONTRACTIONS:
            hit = open_ & (length >= len(ending))
            for k, c in enumerate(ending):
                hit &= room[quote + 1 + k] == ord(c)
            at = quote[hit]
            start[at + 1] = False
            after = at + 1 + len(ending)
            inside = after[length[hit] > len(ending)]
            start[inside] = True
            open_ &= ~hit
    return np.flatnonzero(start)


class Merges:
    """The merge table of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model["type"] != "BPE":
            raise ValueError(f"{path} is not a plain byte-level BPE")
        vocab = model["vocab"]
        # Printable stand-ins for the 256 bytes: those that print stand for themselves, the others follow from 256 on.
        printed = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
        stand_in = {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printed))}
        self.byte_ids = np.array([vocab[stand_in[b]] for b in range(256)], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = np.array([vocab[a] for a, _ in pairs], np.int64), np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # A hash table with one entry a slot; pairs whose slot is taken are looked up in a sorted list.
        self.keys = np.full(1 << 20, -1, np.int64)
        self.ranks = np.zeros(1 << 20, np.int32)
        key = (left << 20) | right
        slot = self._slot(key)
        _, one = np.unique(slot, return_index=True)
        self.keys[slot[one]], self.ranks[slot[one]] = key[one], one
        rest = np.setdiff1d(np.arange(len(key)), one)
        rest = rest[np.argsort(key[rest])]
        self.more_keys, self.more_ranks = key[rest], rest.astype(np.int32)
        self.crowded = np.zeros(1 << 20, bool)
        self.crowded[self._slot(self.more_keys)] = True
        self.none = np.int32(len(pairs))

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 20) | right
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.ranks[slot], self.none)
        odd = np.flatnonzero((out == self.none) & self.crowded[slot])
        if len(odd):
            at = np.minimum(np.searchsorted(self.more_keys, key[odd]), len(self.more_keys) - 1)
            hit = self.more_keys[at] == key[odd]
            out[odd[hit]] = self.more_ranks[at[hit]]
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all sequences of bytes one after another, and the number of ids of each.

        In each round every sequence applies its lowest-ranked pair wherever it stands, left to right without overlap. A merge
        only makes pairs of a higher rank than its own, so this is the order of one pair at a time. Sequences
        without a known pair leave the rounds.
        """
        n = ends - starts
        first = np.cumsum(n) - n
        symbols = self.byte_ids[data[np.arange(int(n.sum()), dtype=np.int64) - np.repeat(first - starts, n)]]
        owner = np.repeat(np.arange(len(n), dtype=np.int64), n)
        done_symbols, done_owner = [], []
        rank = np.full(len(symbols), self.none, np.int32)  # of the pair that begins here
        pair = np.flatnonzero(owner[:-1] == owner[1:])
        rank[pair] = self.rank(symbols[pair], symbols[pair + 1])
        while len(symbols):
            head = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            size = np.diff(np.append(head, len(owner)))
            low = np.minimum.reduceat(rank, head)
            live = low < self.none
            if not live.all():
                stay = np.repeat(live, size)
                done_symbols.append(symbols[~stay])
                done_owner.append(owner[~stay])
                symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
                size, low = size[live], low[live]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(low, size))
            # Overlapping places follow one another directly (one symbol repeated): take every other one of such a streak.
            streak = np.concatenate(([True], at[1:] != at[:-1] + 1))
            begin = np.flatnonzero(streak)
            at = at[(np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # the places after the second symbols are gone
            symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
            touched = np.unique(np.concatenate((moved, moved[moved > 0] - 1)))
            rank[touched] = self.none
            touched = touched[touched + 1 < len(symbols)]
            touched = touched[owner[touched] == owner[touched + 1]]
            rank[touched] = self.rank(symbols[touched], symbols[touched + 1])
        symbols, owner = np.concatenate([*done_symbols, symbols]), np.concatenate([*done_owner, owner])
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(n))


class Tokenizer:
    """Token ids and counts of texts; pre-tokens met before are looked up, by a 64-bit hash and their length."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.length = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int64)

    def _learn(self, key: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        ids, count = self.merges.encode(data, starts, ends)
        at = len(self.ids) + np.cumsum(count) - count
        order = np.argsort(known := np.concatenate((self.known, key)), kind="stable")
        self.known = known[order]
        self.at, self.count = np.concatenate((self.at, at))[order], np.concatenate((self.count, count))[order]
        self.length = np.concatenate((self.length, ends - starts))[order]
        self.ids = np.concatenate((self.ids, ids))

    def _looked_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each pre-token among those known, after learning the others."""
        key, one, back = np.unique(hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
        if len(self.known) + len(key) > REMEMBERED:
            self._forget()
        place = np.searchsorted(self.known, key)
        new = np.ones(len(key), bool)
        if len(self.known):
            new = self.known[np.minimum(place, len(self.known) - 1)] != key
        if new.any():
            self._learn(key[new], data, starts[one[new]], ends[one[new]])
            place = np.searchsorted(self.known, key)
        if (self.length[place] != (ends - starts)[one]).any():
            raise ArithmeticError("two pre-tokens share a hash")
        return place[back]

    def _parts(self, texts: list[str]) -> tuple[list[str], list[int], list[tuple[int, int]]]:
        """The texts cut at special strings: parts, the text of each, and (part before which it stands, id) of each special."""
        special = self.merges.special
        if not special or not any(s in t for s in special for t in texts):
            return texts, list(range(len(texts))), []
        parts, owner, found = [], [], []
        for i, text in enumerate(texts):
            while True:
                # The leftmost special string; of several that begin there, the longest.
                at, _, s = min(((p, -len(s), s) for s in special if (p := text.find(s)) >= 0), default=(-1, 0, ""))
                parts.append(text if at < 0 else text[:at])
                owner.append(i)
                if at < 0:
                    break
                found.append((len(parts), special[s]))
                text = text[at + len(s) :]
        return parts, owner, found

    def _pieces(self, parts: list[str]):
        """Bytes, pre-token bounds in bytes, and the first pre-token of each part."""
        wide = [p.encode("utf-32-le") for p in parts]
        points = np.frombuffer(b"".join(wide), np.uint32)
        cuts = np.concatenate(([0], np.cumsum([len(w) // 4 for w in wide])))
        starts = pretokens(points, cuts)
        width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        byte_at = np.concatenate(([0], np.cumsum(width)))
        data = np.frombuffer(b"".join(p.encode() for p in parts), np.uint8)
        begins = byte_at[starts]
        return data, begins, np.append(begins[1:], len(data)), np.searchsorted(starts, cuts)

    def counts(self, texts: list[str]) -> np.ndarray:
        parts, owner, found = self._parts(texts)
        data, begins, ends, firsts = self._pieces(parts)
        out = np.zeros(len(texts), np.int64)
        if len(begins):
            place = self._looked_up(data, begins, ends)
            total = np.concatenate(([0], np.cumsum(self.count[place])))
            np.add.at(out, owner, total[firsts[1:]] - total[firsts[:-1]])
        for part, _ in found:
            out[owner[part - 1]] += 1
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts, owner, found = self._parts(texts)
        data, begins, ends, firsts = self._pieces(parts)
        if len(begins):
            place = self._looked_up(data, begins, ends)
            n = self.count[place]
            total = np.concatenate(([0], np.cumsum(n)))
            flat = self.ids[np.arange(total[-1]) + np.repeat(self.at[place] - total[:-1], n)]
        else:
            total, flat = np.zeros(1, np.int64), np.zeros(0, np.int64)
        made = [flat[total[a] : total[b]] for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
        if not found:
            return made
        out: list[list[np.ndarray]] = [[] for _ in texts]
        special = dict(found)
        for i, (ids, text) in enumerate(zip(made, owner, strict=True)):
            if i in special:
                out[text].append(np.array([special[i]], np.int64))
            out[text].append(ids)
        return [np.concatenate(x) for x in out]


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """This worker's tokenizer of a file."""
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]
