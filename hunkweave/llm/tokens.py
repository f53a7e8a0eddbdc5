"""Token ids by public tokenizers, with the ids of each distinct word looked up once.

A text is cut where the tokenizer's own rules always cut, so the ids of the parts, one after another, are the ids
of the whole: at the strings of special tokens, which the library takes out before all else; before a single space
between two characters that are no white space and around such a line break (byte-level BPE), or at every space
and line break (word BPE, which drops white space); before a full stop or comma that ends a word.

The words of many texts are handled together, as arrays: a word is known by 128 bits of hashes of its bytes, a table leads from
these to its ids, and the ids of all words are gathered at once.  Only words that the table lacks go to the library.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

END = 1
#: Distinct words whose ids a worker keeps before it starts anew, and slots of their table.
WORDS, SLOTS = 1_200_000, 1 << 22
#: New words that are asked for together, and bytes of texts that are handled together.
RUN, CHUNK = 50, 500_000
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
#: White space besides the space and the line break.
_OTHER_SPACES = [chr(x) for x in (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_SIDE_BY_SIDE = ("  ", "\n\n", " \n", "\n ")
_TABLE = np.random.default_rng(11).integers(0, 2**64, (2, 256), dtype=np.uint64)
#: Odd numbers and their inverses modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_INVERSES = tuple(pow(b, -1, 2**64) for b in _BASES)


def _lower(text: str) -> str:
    """Lower case where every character has one of its own; the tokenizer lowers the rest."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _odd(text: str) -> bool:
    """Whether white space stands at an end, side by side, or is other than spaces and line breaks."""
    return text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _SIDE_BY_SIDE) or any(x in text for x in _OTHER_SPACES)


def _powers(base: int, n: int, kept: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """base**0 .. base**(n - 1) modulo 2**64."""
    if base not in kept or len(kept[base]) < n:
        factors = np.full(max(n, 1), base, np.uint64)
        factors[0] = 1
        kept[base] = np.cumprod(factors)
    return kept[base][:n]


def _hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each run of bytes; the runs are ascending and lie side by side."""
    out = []
    for table, base, inverse in zip(_TABLE, _BASES, _INVERSES):
        h = np.empty(len(starts), np.uint64)
        a = 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + CHUNK, "right")))
            lo, hi = int(starts[a]), int(ends[b - 1])
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(table[buf[lo:hi]] * _powers(base, hi - lo), out=sums[1:])
            h[a:b] = (sums[ends[a:b] - lo] - sums[starts[a:b] - lo]) * _powers(inverse, hi - lo)[starts[a:b] - lo]
            a = b
        out.append(h ^ (h >> np.uint64(31)) + (ends - starts).astype(np.uint64))
    return out[0], out[1]


class _Known:
    """Rows of ids by the two hashes of their word."""

    def __init__(self) -> None:
        self.slots = np.full(SLOTS, -1, np.int32)
        self.h, self.starts, self.sizes, self.flat = np.empty((0, 2), np.uint64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.uint32)
        self.n = self.used = 0

    def _slot(self, h1: np.ndarray) -> np.ndarray:
        return (h1 >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The row of each word, or -1."""
        out, at, slot = np.full(len(h1), -1), np.arange(len(h1)), self._slot(h1)
        while len(at):
            row = self.slots[slot]
            there = row >= 0
            at, slot, row = at[there], slot[there], row[there]
            h = self.h[row]
            same = (h[:, 0] == h1[at]) & (h[:, 1] == h2[at])
            out[at[same]] = row[same]
            at, slot = at[~same], (slot[~same] + 1) % SLOTS
        return out

    def add(self, h1: np.ndarray, h2: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Adds different words that aren't there; ids: those of all, one after another."""
        n, m = len(h1), len(ids)
        if self.n + n > len(self.h):
            room = max(2 * len(self.h), self.n + n, 65_536)
            self.h, self.starts, self.sizes = (np.resize(x, (room, *x.shape[1:])) if len(x) else np.empty((room, *x.shape[1:]), x.dtype) for x in (self.h, self.starts, self.sizes))
        if self.used + m > len(self.flat):
            self.flat = np.concatenate((self.flat[: self.used], np.empty(max(self.used, m, 65_536), np.uint32)))
        self.h[self.n : self.n + n, 0], self.h[self.n : self.n + n, 1], self.sizes[self.n : self.n + n] = h1, h2, sizes
        self.starts[self.n : self.n + n] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + m] = ids
        rows, slot = np.arange(self.n, self.n + n, dtype=np.int32), self._slot(h1)
        while len(rows):
            free = np.flatnonzero(self.slots[slot] < 0)
            self.slots[slot[free]] = rows[free]
            lost = self.slots[slot] != rows
            rows, slot = rows[lost], (slot[lost] + 1) % SLOTS
        self.n, self.used = self.n + n, self.used + m

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all these rows, where each row's begin and the last ends)."""
        sizes = self.sizes[rows]
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return self.flat[np.arange(ends[-1]) + np.repeat(self.starts[rows] - ends[:-1], sizes)], ends


class Encoder:
    """ids(text) gives what the library does for a whole text without adding special tokens, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = json.loads(self.tokenizer.to_str())["added_tokens"]
        # Tokens that take in white space or need word edges around them would change the parts beside them.
        assert not any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in added), "added tokens of another kind"
        self.special = {x["content"]: np.array([x["id"]], "<u4").tobytes() for x in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        spaced = self.tokenizer.encode(" b", add_special_tokens=False).ids
        self.drops_space = spaced == self.tokenizer.encode("b", add_special_tokens=False).ids
        signs = sorted(self.tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.edge = np.zeros(signs[-1][1] + 1, bool)
        self.edge[[i for x, i in signs if (x.endswith("</w>") if self.drops_space else x.startswith("Ġ"))]] = True
        self.known = _Known()
        #: Ids of parts that hold other white space.
        self.odd: dict[str, bytes] = {}

    def _whole(self, parts: list[str]) -> list[list[int]]:
        """The library's ids of each part as it stands."""
        return [e.ids for at in range(0, len(parts), 20_000) for e in self.tokenizer.encode_batch_fast(parts[at : at + 20_000], add_special_tokens=False)]

    def _asked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which word, how many ids, ids one after another) by the library.

        Words of letters after a space are asked for many at a time: each is one word to the tokenizer, which begins with the
        space's sign (byte-level BPE) or ends with the word's (word BPE), and so tells its ids from the next one's.
        """
        one, other = [], []
        for i, x in enumerate(words):
            (one if x[0] == " " and x[1:].isalpha() else other).append(i)
        which, sizes, ids = [], [], []
        for at in range(0, len(one), RUN):
            some = one[at : at + RUN]
            own = np.array(self.tokenizer.encode("".join([words[i] for i in some]), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(self.edge[own])
            if len(cuts) != len(some):
                other += some
                continue
            which += some
            sizes.append(np.diff(cuts, prepend=-1) if self.drops_space else np.diff(cuts, append=len(own)))
            ids.append(own)
        for i, own in zip(other, self._whole([words[i] for i in other])):
            which.append(i)
            sizes.append([len(own)])
            ids.append(np.array(own, np.uint32))
        return np.array(which, np.int64), np.concatenate([*sizes, []]).astype(np.int64), np.concatenate([*ids, np.empty(0, np.uint32)])

    def _words(self, buf: np.ndarray) -> np.ndarray:
        """Where words begin: at a space or line break, and at a full stop or comma between a Latin letter and one of these."""
        space = (buf == 32) | (buf == 10)
        stop = np.flatnonzero((buf == 44) | (buf == 46))
        stop = stop[np.concatenate((space[1:], [True]))[stop]]
        last, lead = buf[stop - 1], buf[np.maximum(stop - 2, 0)]
        # A-Z, a-z, or in two bytes the letters from À to ÿ.
        letter = ((last & 0xDF) - 65 < 26) | ((lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))
        space[stop[letter]] = True
        return np.flatnonzero(space)

    def _many(self, raws: list[bytes]) -> list[np.ndarray]:
        """Ids of texts, each of which begins with a space or a line break."""
        raw = b"".join(raws)
        buf = np.frombuffer(raw, np.uint8)
        starts = self._words(buf)
        ends = np.append(starts[1:], len(buf))
        h1, h2 = _hashes(buf, starts, ends)
        rows = self.known.find(h1, h2)
        new = np.flatnonzero(rows < 0)
        if len(new):
            if self.known.n + len(new) > WORDS:
                self.known = _Known()
                new = np.arange(len(starts))
            order = new[np.lexsort((h2[new], h1[new]))]
            new = order[np.concatenate(([True], (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])))]
            words = [raw[a:b].decode() for a, b in zip(starts[new].tolist(), ends[new].tolist())]
            which, sizes, ids = self._asked(words)
            self.known.add(h1[new[which]], h2[new[which]], sizes, ids)
            rows = self.known.find(h1, h2)
        ids, at = self.known.gather(rows)
        firsts = np.searchsorted(starts, np.cumsum([0, *map(len, raws)]))
        return [ids[at[a] : at[b]] for a, b in zip(firsts.tolist(), firsts[1:].tolist())]

    def _odd_ids(self, text: str) -> bytes:
        parts = _SAFE_CUT.split(text)
        new = list(set(parts) - self.odd.keys())
        if len(self.odd) + len(new) > WORDS // 16:
            self.odd.clear()
            new = list(set(parts))
        self.odd.update((x, np.array(i, "<u4").tobytes()) for x, i in zip(new, self._whole(new)))
        return b"".join([self.odd[x] for x in parts])

    def _with_special(self, text: str) -> bytes:
        """Each special token between what the library makes of the texts around it."""
        return b"".join([self.special.get(x) or self.ids(x) for x in self.cut.split(text) if x])

    def ids(self, text: str | None) -> bytes:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        held: list[int] = []
        raws: list[bytes] = []
        size = 0

        def flush() -> None:
            nonlocal size
            # A text begins with a line break (byte-level BPE) or a space that isn't its own; the line break is an id.
            for i, ids in zip(held, self._many(raws) if raws else ()):
                out[i] = ids[0 if self.drops_space else 1 :].astype("<u4").tobytes()
            held.clear()
            raws.clear()
            size = 0

        for i, text in enumerate(texts):
            if not text:
                continue
            if any(x in text for x in self.special):
                out[i] = self._with_special(text)
            elif not self.drops_space and _odd(text):
                out[i] = self._odd_ids(text)
            else:
                held.append(i)
                raws.append((" " + _lower(text).replace("\n", " ") if self.drops_space else "\n" + text).encode())
                size += len(raws[-1])
                if size >= CHUNK:
                    flush()
        flush()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
