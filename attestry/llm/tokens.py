"""Token ids of whole documents by a public tokenizer file, with worker caches.

The texts of a block are split into pre-tokens in numpy, by classes of code
points; each distinct pre-token is looked up once a block, first in a table
handed in by the caller, then in the worker's cache, and only a miss is encoded
by the library's own model.  The class table has the scripts of Unicode 3.2 and
all that is neither letter nor digit.  Texts with other code points, with special
strings or (where the tokenizer composes) in decomposed form go through the
library's whole pipeline, so every text gets the library's ids.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Callable
from functools import lru_cache
from typing import NamedTuple

import numpy as np

from attestry.llm import worker
from attestry.llm.text import Block, mix, powers

#: Entries that a worker's cache may hold between blocks, and their ids (64 MB).
CACHE_SIZE, CACHE_IDS = 1_000_000, 16_000_000

#: Ids of the longest entry that stays when the cache is full.
LONG = 16

#: Text bytes of a block; a pre-token is looked up once a block.
BLOCK = 4 << 20

#: Code points below this have a class; the planes above hold no common script.
PLAIN_UP_TO = 0x30000
#: Spaces in one version of Unicode or one library and not in another.
NOT_PLAIN = (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0x180E)

#: Fixed value: the splitting pattern of the word-end layout.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

LETTER, NUMBER, SPACE, OTHER, FOREIGN = range(5)
_MUL = 0xC2B2AE3D27D4EB4F

#: Code points hashed at once.
CHUNK = 1 << 17


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point.  Letters and digits that Unicode 3.2 had not got
    and code points without a character are foreign, as the library's tables may
    be older or newer than Python's."""
    table = np.full(0x110000, FOREIGN, np.uint8)
    first = unicodedata.ucd_3_2_0.category
    for c in range(PLAIN_UP_TO):
        ch = chr(c)
        kind = unicodedata.category(ch)[0]
        if c in NOT_PLAIN or unicodedata.category(ch) in ("Cs", "Cn") or (kind in "LN") != (first(ch)[0] in "LN"):
            continue
        table[c] = LETTER if kind == "L" else NUMBER if kind == "N" else SPACE if ch.isspace() else OTHER
    return table


worker.caching(_classes.cache_clear)


@lru_cache(1)
def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level models use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return out


class Ids(NamedTuple):
    """Ids (or lengths) of rows: ``values`` row after row, with ``bounds``."""

    values: np.ndarray
    bounds: np.ndarray


class Cache:
    """Ids of pre-tokens by hash, in arrays.

    Entry ``i`` has the ids ``flat[head[i]:head[i] + size[i]]``; ``order`` has the
    entries by ascending hash, ``used`` the last block that asked for each.
    """

    def __init__(self):
        self.keys, self.order, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.uint32)
        self.head, self.size, self.used = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.turn = 0

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each of some ascending hashes, -1 for a miss."""
        if not len(self):
            return np.full(len(keys), -1, np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self) - 1)
        found = np.where(self.keys[at] == keys, self.order[at], -1)
        self.used[found[found >= 0]] = self.turn
        return found

    def add(self, keys: np.ndarray, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entries of ascending hashes that were not there."""
        new = np.arange(len(self), len(self) + len(keys), dtype=np.int32)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.order = np.insert(self.keys, at, keys), np.insert(self.order, at, new)
        self.head = np.append(self.head, len(self.flat) + np.cumsum(size, dtype=np.int64) - size)
        self.flat, self.size = np.append(self.flat, flat), np.append(self.size, size)
        self.used = np.append(self.used, np.full(len(keys), self.turn))
        return new

    def next_block(self) -> None:
        """Of a full cache, half at most stays: short entries that were asked for last."""
        self.turn += 1
        if len(self) <= CACHE_SIZE and len(self.flat) <= CACHE_IDS:
            return
        keep = self.size <= LONG
        if len(self) > CACHE_SIZE // 2:
            keep &= self.used > -np.partition(-self.used, CACHE_SIZE // 2)[CACHE_SIZE // 2]
        self.flat = self.flat[np.repeat(keep, self.size)]
        at = keep[self.order]
        self.keys, self.order = self.keys[at], (np.cumsum(keep, dtype=np.int32) - 1)[self.order[at]]
        self.size, self.used = self.size[keep], self.used[keep]
        self.head = np.cumsum(self.size, dtype=np.int64) - self.size


class Encoder:
    """``add_special_tokens=False`` encoding by a ``tokenizers`` file.

    Two layouts are split in numpy: byte-level with the usual pattern, and the
    lower-casing word-end one whose pattern drops white space.  Any other file
    is encoded by the library alone.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        layout = json.loads(self.library.to_str())
        self.special = [t["content"] for t in layout["added_tokens"]]
        self.model = self.library.model
        self.lowers = bool(layout["normalizer"])
        pre = layout["pre_tokenizer"]
        byte_level = pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not layout["normalizer"]
        word_end = self.lowers and pre["type"] == "Sequence" and pre["pretokenizers"][0].get("pattern") == {"Regex": WORD_PATTERN} and pre["pretokenizers"][0]["invert"]
        self.known = bool(byte_level or word_end)
        self.cache = Cache()

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens one after the other, and the number of each."""
        # Byte 0xFF, which is in no UTF-8 text, parts the pieces.
        tokenize, letters = self.model.tokenize, _byte_letters()
        mapped = "\udcff".join(pieces).encode("utf-8", "surrogateescape").decode("latin1").translate(letters)
        ids, size = array("I"), array("i")
        for piece in mapped.split(letters[0xFF]) if pieces else ():
            got = [t.id for t in tokenize(piece)]
            ids.extend(got)
            size.append(len(got))
        return np.frombuffer(ids, np.uint32), np.frombuffer(size, np.int32)

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def normal(self, text: str) -> str:
        """What the splitter takes of a plain text."""
        return text.lower() if self.lowers else text

    def _plain(self, text: str) -> bool:
        """No special string; where case is folded, composed and without the one
        letter whose lower case depends on its neighbours."""
        if any(s in text for s in self.special):
            return False
        return not self.lowers or text.isascii() or ("\u03a3" not in text and unicodedata.is_normalized("NFC", text))

    @staticmethod
    def read(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """Joined text, bounds by row, and each code point with its class."""
        row = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        return joined, row, points, _classes()[points]

    def split(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        """Joined text, start and end of each pre-token, and bounds by row."""
        return self.split_read(*self.read(texts))

    def split_read(self, joined: str, row: np.ndarray, points: np.ndarray, kind: np.ndarray) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        n = len(points)
        if not n:
            return joined, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(row), np.int64)
        head = np.zeros(n + 1, bool)
        head[row] = True
        cut = head[:-1].copy()  # a pre-token starts here
        cut[1:] |= kind[1:] != kind[:-1]
        if self.lowers:
            cut |= kind == NUMBER
        quote = np.flatnonzero((points == 0x27) & cut)
        quote = quote[quote + 1 < n]
        alone = cut[quote + 1] & ~head[quote + 1] & (kind[quote + 1] == LETTER)
        if not self.lowers:  # a space before the quote takes it
            alone &= head[quote] | (points[quote - 1] != 0x20)
        quote = quote[alone]
        one = np.isin(points[quote + 1], [ord(c) for c in "stmd"])
        pair = np.zeros(len(quote), bool)
        two = (quote + 2 < n) & ~head[np.minimum(quote + 2, n)]
        second = points[np.minimum(quote + 2, n - 1)]
        for a, b in ("re", "ve", "ll"):
            pair |= (points[quote + 1] == ord(a)) & (second == ord(b)) & two
        for at, width in ((quote[one], 1), (quote[pair & ~one], 2)):
            cut[at + 1] = False
            after = at + 1 + width
            cut[after[after < n]] = True
        if not self.lowers:
            # The last of some spaces before a word joins it if it is 0x20, else stands alone.
            last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~head[1:-1])
            cut[last] = True
            joins = last[points[last] == 0x20]
            cut[joins + 1] = False
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        if self.lowers:
            word = kind[start] != SPACE
            start, end = start[word], end[word]
        return joined, start, end, np.searchsorted(start, row)

    @staticmethod
    def hash_pieces(joined: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each pre-token, some ``CHUNK`` code points at a time."""
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        out, n, i = np.empty(len(start), np.uint64), len(start), 0
        while i < n:
            lo = start[i]
            j = max(int(np.searchsorted(start, lo + CHUNK)), i + 1)
            a, b = start[i:j] - lo, end[i:j] - lo
            size = int(b[-1])
            up, down = powers(_MUL, size + 1)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum((points[lo : lo + size].astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
            out[i:j] = mix(mix((sums[b] - sums[a]) * down[a]) + (b - a).astype(np.uint64))
            i = j
        return out

    def block(self, block: Block, known: Callable | None = None, lengths: bool = False) -> Ids:
        """Ids of each row of a block; with ``lengths`` only their number.

        ``known`` maps an array of pre-token hashes to lengths, -1 for a miss.
        """
        texts = [block.text(i).decode() for i in range(len(block))]
        plain = [self.known and self._plain(t) for t in texts]
        texts = [self.normal(t) if p else t for t, p in zip(texts, plain, strict=True)]
        read = self.read(texts)
        _, row, _, kind = read
        odd = np.flatnonzero(kind == FOREIGN)
        plain = np.array(plain, bool) & (np.searchsorted(odd, row[1:]) == np.searchsorted(odd, row[:-1]))
        if not plain.all():
            read = self.read([t if p else "" for t, p in zip(texts, plain, strict=True)])
        joined, start, end, bounds = self.split_read(*read)
        hashes = self.hash_pieces(joined, start, end)
        value, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        count = known(value) if known else np.full(len(value), -1)
        self.cache.next_block()
        asked = np.flatnonzero(count < 0) if lengths else np.arange(len(value))
        entry = self.cache.find(value[asked])
        missed = np.flatnonzero(entry < 0)
        if len(missed):
            at = first[asked[missed]]
            pieces = [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            entry[missed] = self.cache.add(value[asked[missed]], *self.encode_pieces(pieces))
        if lengths:
            count[asked] = self.cache.size[entry]
        whole = {int(i): self.encode_whole(block.text(i).decode()) for i in np.flatnonzero(~plain)}
        if lengths:
            per_row = np.concatenate([[0], np.cumsum(count[inverse])])
            n = per_row[bounds[1:]] - per_row[bounds[:-1]]
            for i, ids in whole.items():
                n[i] = len(ids) // 4
            return Ids(n, np.arange(len(n) + 1))
        flat, size, head = self.cache.flat, self.cache.size[entry][inverse], self.cache.head[entry][inverse]
        total = np.concatenate([[0], np.cumsum(size)])
        out = flat[np.repeat(head - total[:-1], size) + np.arange(total[-1])]
        rows = total[bounds]
        if whole:
            pieces = [np.frombuffer(whole[i], np.uint32) if i in whole else out[rows[i] : rows[i + 1]] for i in range(len(texts))]
            out = np.concatenate(pieces)
            rows = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        return Ids(out, rows)


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """The worker's encoder of a file, kept from batch to batch."""
    return Encoder(path)


worker.caching(encoder.cache_clear)


def path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
