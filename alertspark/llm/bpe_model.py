"""Byte-level BPE: merge list, sufficient lookahead and the streaming transducer.

Sufficient lookahead. Compare the merging of a text ``w`` with that of ``w+v``.
Left of some place p both runs have the same tokens; p starts at the end of w.
p moves left only when one run applies a rule (x, z) across it, x ending and z
starting at p, and the other does not; then it moves by len(x). The next such
rule (x2, z2) has a later rank, and z2 starts where x starts, so x lies on the
left spine of z2 (z2 is x or was built from it by merges on its right). The
longest chain of such rules, weighed by len(x), therefore bounds how far any
continuation can reach back: tokens that end further from the end are final.
One pass over the rules in rank order finds it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import regex

from alertspark.llm.common import text_buffers

#: Strings of up to so many characters are remembered, twice so many of them at most.
REMEMBERED_CHARS, REMEMBERED = 64, 80_000
#: Bytes of text whose distinct stretches are found at once.
AT_ONCE = 1 << 21
#: A rule is its rank << 32 | the token it makes.
_NO_RULE, _ID = 1 << 62, (1 << 32) - 1


#: Pre-token rule of the byte-level vocabularies (fixed value; white space is Unicode White_Space).
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: The same rule for text below U+0250, its classes spelled out for the standard engine.
_LOW_END = 0x250


@cache
def _rules() -> tuple:
    low = "".join(map(chr, range(_LOW_END)))
    let, num, gap = ("".join(map(re.escape, regex.findall(p, low))) for p in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
    own = f" ?[{let}]+|'(?:[stmd]|re|ve|ll)| ?[{num}]+| ?[^{gap}{let}{num}]+|[{gap}]+(?![^{gap}])|[{gap}]+"
    return re.compile(own).findall, regex.compile(PRE_TOKEN).findall


def pre_tokens(s: str) -> list[str]:
    low, full = _rules()
    return low(s) if s.isascii() or max(s) < chr(_LOW_END) else full(s)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(0x100 + other.index(b)) for b in range(256)]


class BpeModel:
    """Vocabulary and merges of a byte-level BPE file; small (bounded by the vocabulary), shipped by broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_chars())}
        raw = lambda s: bytes(back[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in [*vocab.items(), *((k.encode(), v) for k, v in self.special.items())]:
            self.bytes_of[i] = s
        self.byte_id = [vocab.get(bytes([b])) for b in range(256)]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): rank << 32 | vocab[a + b] for rank, (a, b) in enumerate((raw(x), raw(y)) for x, y in pairs)}
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        spine: dict[int, list[int]] = {i: [i] for i in self.byte_id if i is not None}
        reach: dict[int, int] = {}
        most = 0
        for (x, z), rule in self.merges.items():
            made = rule & _ID
            spine.setdefault(made, [made, *spine.get(x, [x])])
            total = len(self.bytes_of[x]) + max(reach.get(s, 0) for s in spine.get(z, [z]))
            reach[x] = max(reach.get(x, 0), total)
            most = max(most, total)
        return most

    def merge(self, data: bytes) -> list[int]:
        """Tokens of one pre-token: the pair of lowest rank first, leftmost of equals."""
        ids = [self.byte_id[b] for b in data]
        look = self.merges.get
        rules = [look(p, _NO_RULE) for p in zip(ids, ids[1:])]
        while rules:
            rule = min(rules)
            if rule == _NO_RULE:
                break
            i = rules.index(rule)
            ids[i] = rule & _ID
            del ids[i + 1], rules[i]
            if i < len(rules):
                rules[i] = look((ids[i], ids[i + 1]), _NO_RULE)
            if i:
                rules[i - 1] = look((ids[i - 1], ids[i]), _NO_RULE)
        return ids

    def transduce(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Tokens of one pre-token that arrives in chunks, each as soon as it is stable.

        Holds at most a few lookaheads of bytes, however long the pre-token is.
        """
        room = 4 * self.lookahead + 64
        held = b""
        for chunk in chunks:
            for i in range(0, len(chunk), room):
                held += chunk[i : i + room]
                if len(held) <= self.lookahead:
                    continue
                done, stable = 0, len(held) - self.lookahead
                for t in self.merge(held):
                    done += len(self.bytes_of[t])
                    if done > stable:
                        done -= len(self.bytes_of[t])
                        break
                    yield t
                held = held[done:]
        yield from self.merge(held)

    def pre_token(self, s: str) -> list[int]:
        data = s.encode("utf-8", "surrogatepass")
        if len(data) <= 4 * self.lookahead:
            return self.merge(data)
        return list(self.transduce(data[i : i + 4096] for i in range(0, len(data), 4096)))

    def alone(self) -> set[str]:
        """Vocabulary strings whose own encoding is one token and that are one pre-token when they stand alone.

        Proved by encoding each of them; a pre-token equal to such a string counts as one.
        """
        out: set[str] = set()
        for i, raw in enumerate(self.bytes_of):
            if raw and (raw.decode("utf-8", "ignore").encode() == raw):
                s = raw.decode()
                if s not in self.special and pre_tokens(s) == [s] and self.merge(raw) == [i]:
                    out.add(s)
        return out


#: Bytes that end or begin white space, for the test of a space's neighbours.
_ASCII_GAP = np.zeros(256, bool)
_ASCII_GAP[[*range(9, 14), *range(0x1C, 0x21)]] = True


def space_cuts(data: np.ndarray) -> np.ndarray:
    """Places of the spaces in UTF-8 text that stand between two visible characters.

    Such a space starts a pre-token (a pre-token has white space at its start
    only, and one space before a visible character belongs to it), so the
    stretches between such places can be encoded one by one. Where a neighbour
    might be white space of several bytes, there is no cut.
    """
    at = np.flatnonzero(data == 0x20)
    at = at[(at > 0) & (at < len(data) - 1)]
    after, before = data[at + 1], data[at - 1]
    second, third = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    wide = ((second == 0xC2) & ((before == 0x85) | (before == 0xA0))) | ((third >= 0xE1) & (third <= 0xE3) & ((second == 0x80) | (second == 0x81) | (second == 0x9A)))
    maybe = (after == 0xC2) | ((after >= 0xE1) & (after <= 0xE3))
    return at[~(_ASCII_GAP[after] | _ASCII_GAP[before] | wide | maybe)]


def special_cuts(data: np.ndarray, special: dict[str, int]) -> list[int]:
    """Starts and ends of the special strings in UTF-8 text, the leftmost and longest first."""
    if not special:
        return []
    rule = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(special, key=len, reverse=True)))
    return [x for m in rule.finditer(data) for x in m.span()]


@dataclass
class Stretches:
    """Documents ``first .. first+len(at)-2`` of a batch as stretches: ``codes`` into the distinct ``texts``; document i has ``codes[at[i]:at[i+1]]``."""

    first: int
    texts: list[str]
    codes: np.ndarray
    at: np.ndarray


def stretches(texts: pa.Array, special: dict[str, int], at_once: int = AT_ONCE) -> Iterator[Stretches]:
    """The whole texts as stretches, documents of about ``at_once`` bytes at a time; equal stretches are found by Arrow's dictionary."""
    data, off = text_buffers(texts)
    n, i = len(off) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + at_once, "right")) - 1))
        some, ends = data[off[i] : off[j]], off[i : j + 1] - off[i]
        edge = np.zeros(len(some) + 1, bool)
        edge[space_cuts(some)] = edge[ends] = True
        if special and any(s.encode() in bytes(some.data) for s in special):
            for a, b in zip(ends[:-1], ends[1:]):  # a special string lies within one document
                edge[a + np.array(special_cuts(some[a:b], special), np.int64)] = True
        cut = np.flatnonzero(edge) if len(some) else np.zeros(1, np.int64)
        pieces = pa.Array.from_buffers(pa.large_string(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(some))])
        found = pieces.dictionary_encode()
        yield Stretches(i, found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy(), np.searchsorted(cut, ends))
        i = j


class Remembered(dict):
    """string -> what ``make`` gives for it, in two generations of bounded size.

    When the younger is full it becomes the older and the older is forgotten;
    what is asked for again moves up, so frequent strings stay.
    """

    def __init__(self, make: Callable[[str], object], size: int = REMEMBERED):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, s: str):
        got = self.old.get(s)
        if got is None:
            got = self.make(s)
        if len(s) <= REMEMBERED_CHARS:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[s] = got
        return got
