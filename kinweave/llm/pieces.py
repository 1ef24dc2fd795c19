"""SentencePiece model files: the piece table, units of text, and exact per-unit encoders."""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from dataclasses import dataclass, field
from functools import cached_property

import ahocorasick

TOKENIZERS = "/opt/tokenizers"
MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
BLANK = "▁"
#: Fixed values of the file format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: What an unknown character costs below the least score.
UNKNOWN_PENALTY = 10.0
#: Parts of a text longer than this are cut into the smallest units.
WIDE = 40
#: Units up to this length are merged by scanning.
SHORT = 48
#: Entries that a worker's memo holds before it starts anew.
MEMO = 400_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return value, i


def _fields(b: bytes):
    """(number, value) of a protocol-buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            value, i = _varint(b, i)
        elif tag & 7 == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if tag & 7 == 5 else 8
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


@dataclass
class Pieces:
    """A piece table. kind: UNIGRAM (best total score) or BPE (merges by score)."""

    pieces: list[str]
    scores: list[float]
    types: list[int]
    kind: int
    dummy_prefix: bool = True
    memo: dict = field(default_factory=dict, repr=False)

    @classmethod
    def read(cls, path: str = MODEL, kind: int | None = None) -> Pieces:
        """The table of a model file; kind overrides the file's own."""
        pieces, scores, types, own, prefix = [], [], [], UNIGRAM, True
        for number, value in _fields(open(path, "rb").read()):
            if number == 1:
                entry = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                pieces.append(entry[1].decode())
                scores.append(struct.unpack("<f", entry[2])[0])
                types.append(entry[3])
            elif number == 2:
                own = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = {1: b"identity", 2: b"", 3: 1, 4: 1} | dict(_fields(value))
                prefix = bool(spec[3])
                if spec[2] or spec[4]:
                    raise ValueError("only models that keep every character are supported")
        return cls(pieces, scores, types, kind or own, prefix)

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("pieces", "scores", "types", "kind", "dummy_prefix")} | {"memo": {}}

    @cached_property
    def ids(self) -> dict[str, int]:
        """Piece -> id, of the pieces that text is cut into."""
        return {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, USER_DEFINED)}

    @cached_property
    def byte_ids(self) -> list[int]:
        by = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        return [by.get(f"<0x{k:02X}>", self.types.index(UNKNOWN)) for k in range(256)]

    @cached_property
    def order(self) -> dict[str, tuple[float, int]]:
        """Piece -> (-score, id); smaller merges first."""
        return {p: (-self.scores[i], i) for p, i in self.ids.items()}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids))

    @cached_property
    def longer(self) -> set[str]:
        """The characters of longer pieces, but for the blank."""
        return {c for p in self.ids if len(p) > 1 for c in p} - {BLANK}

    @cached_property
    def unit(self) -> re.Pattern:
        """Units: no piece reaches from one into the next. Blanks with the word after them, or one character that is in no longer piece."""
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("pieces with inner blanks are not supported")
        known = "".join(map(re.escape, sorted(self.longer)))
        return re.compile(f"{BLANK}+[{known}]*|[{known}]+|(?s:.)" if known else f"{BLANK}+|(?s:.)")

    def units(self, text: str) -> list[str]:
        """Units of a text, in order, some of them empty; joined they give the escaped text."""
        if not text:
            return []
        prefix = BLANK * self.dummy_prefix
        if "  " in text or "\0" in text or BLANK in text or text[0] == " " or "\n" in self.longer:
            return self.unit.findall(prefix + text.replace(" ", BLANK))
        # Single blanks and line feeds only: cut before each blank and round each line feed; other characters without longer pieces may stay inside a unit.
        parts = (prefix + text.replace(" ", "\0" + BLANK).replace("\n", "\0\n\0")).split("\0")
        return parts if max(map(len, parts)) <= WIDE else [u for p in parts for u in (self.unit.findall(p) if len(p) > WIDE else (p,))]

    def fallback(self, char: str) -> list[int]:
        """The ids of a character that is no piece."""
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def _to_ids(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            i = self.ids.get(p)
            out += self.fallback(p) if i is None else [i]
        return out

    @cached_property
    def ranks(self) -> dict[str, int]:
        """Piece -> place of its score, 0 the best; equal scores share a place."""
        place = {s: k for k, s in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        return {p: place[self.scores[i]] for p, i in self.ids.items()}

    def merge(self, unit: str) -> list[str]:
        """BPE: the adjacent pair whose union is the best piece is joined, the leftmost of equals, as long as one is."""
        if len(unit) > SHORT:
            return self._merge_long(unit)
        parts, rank, never = list(unit), self.ranks.get, len(self.pieces)
        costs = [rank(a + b, never) for a, b in zip(parts, parts[1:])]
        while costs and (least := min(costs)) < never:
            i = costs.index(least)
            parts[i] += parts.pop(i + 1)
            costs.pop(i)
            if i:
                costs[i - 1] = rank(parts[i - 1] + parts[i], never)
            if i < len(costs):
                costs[i] = rank(parts[i] + parts[i + 1], never)
        return parts

    def _merge_long(self, unit: str) -> list[str]:
        """merge() with a heap, for units whose length squared would tell."""
        n, score = len(unit), self.order
        start, after, before, end = list(range(n)), list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(s[0], i, i + 2) for i in range(n - 1) if (s := score.get(unit[i : i + 2]))]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if start[i] >= 0 else n
            if j >= n or start[j] < 0 or end[j] != stop:
                continue
            start[j], after[i], end[i] = -1, after[j], stop
            if after[i] < n:
                before[after[i]] = i
                if s := score.get(unit[i : end[after[i]]]):
                    heapq.heappush(heap, (s[0], i, end[after[i]]))
            if (h := before[i]) >= 0 and (s := score.get(unit[h:stop])):
                heapq.heappush(heap, (s[0], h, stop))
        return [unit[i : end[i]] for i in range(n) if start[i] >= 0]

    @cached_property
    def matcher(self):
        """An Aho-Corasick automaton of the pieces; its values are (length, score)."""
        a = ahocorasick.Automaton()
        for p, i in self.ids.items():
            a.add_word(p, (len(p), self.scores[i]))
        a.make_automaton()
        return a

    def viterbi(self, unit: str) -> list[str]:
        """Unigram: the cut of greatest total score in single precision; of equals the one whose last piece is longest."""
        n = len(unit)
        unknown = min(self.scores[i] for i in self.ids.values()) - UNKNOWN_PENALTY
        best, back, tmp = array("f", [0.0] * (n + 1)), [-1] * (n + 1), array("f", [0.0])
        single = [True] * n
        ends: list[list] = [[] for _ in range(n)]
        for last, match in self.matcher.iter(unit):
            ends[last].append(match)
            single[last] &= match[0] != 1
        for last in range(n):
            for size, score in ends[last] + [(1, unknown)] * single[last]:
                tmp[0] = best[last + 1 - size] + score
                if back[last + 1] < 0 or tmp[0] > best[last + 1]:
                    best[last + 1], back[last + 1] = tmp[0], last + 1 - size
        out, at = [], n
        while at:
            out.append(unit[back[at] : at])
            at = back[at]
        return out[::-1]

    def _stands(self, a: str, b: str) -> bool:
        """Whether merging a + b from single characters ends with just a and b."""
        key = (a, b)
        known = self.memo.get(key)
        if known is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            known = self.memo[key] = self.merge(a + b) == ([a, b] if a else [b])
        return known

    def count(self, unit: str) -> int:
        """The number of ids of a unit, by dynamic programming over the automaton's matches, without the cut itself.

        UNIGRAM carries the best score and its count. BPE carries, for each prefix, its last piece
        and count: a cut is the merge result just if merging any two neighbours alone leaves them
        as they are, so each prefix has one piece that can follow the last piece before it."""
        n = len(unit)
        counts, bytes_ = [0] * (n + 1), [0] * n
        ends: list[list] = [[] for _ in range(n)]
        single = [True] * n
        for last, match in self.matcher.iter(unit):
            ends[last].append(match)
            single[last] &= match[0] != 1
        for last in range(n):
            bytes_[last] = len(self.fallback(unit[last])) if single[last] else 1
        if self.kind == BPE:
            pieces = [""] * (n + 1)
            for last in range(n):
                for size in [m[0] for m in ends[last]] + [1] * single[last]:
                    at, piece = last + 1 - size, unit[last + 1 - size : last + 1]
                    if self._stands(pieces[at], piece):
                        pieces[last + 1], counts[last + 1] = piece, counts[at] + (bytes_[last] if size == 1 else 1)
                        break
            return counts[n]
        unknown = min(self.scores[i] for i in self.ids.values()) - UNKNOWN_PENALTY
        best, tmp, seen = array("f", [0.0] * (n + 1)), array("f", [0.0]), [True] + [False] * n
        for last in range(n):
            for size, score in ends[last] + [(1, unknown)] * single[last]:
                tmp[0] = best[last + 1 - size] + score
                if not seen[last + 1] or tmp[0] > best[last + 1]:
                    seen[last + 1], best[last + 1] = True, tmp[0]
                    counts[last + 1] = counts[last + 1 - size] + (bytes_[last] if size == 1 else 1)
        return counts[n]

    def encode_unit(self, unit: str) -> list[int]:
        """The ids of one unit."""
        return self._to_ids(self.merge(unit) if self.kind == BPE else self.viterbi(unit))

    @cached_property
    def spelled(self) -> list[bytes]:
        """Id -> the bytes that it stands for."""
        out = []
        for p, t in zip(self.pieces, self.types):
            out.append(bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(BLANK, " ").encode())
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of a list of ids."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text
