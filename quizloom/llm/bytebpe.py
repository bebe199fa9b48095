"""A byte-level BPE vocabulary and the two per-piece routines built on it.

The vocabulary file is read on the driver and broadcast (its size is that of a
fixed public file, a few MB), so executors need no local copy.  Tasks build one
:class:`ByteBpe` per Python worker and keep it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from itertools import chain, pairwise

import numpy as np
import regex

# The split pattern of the public byte-level vocabulary, with white
# space spelled as the Unicode property so that every engine reads it alike.
_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\p{White_Space}{LN}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
PIECES = regex.compile(_PATTERN.replace("{LN}", r"\p{L}\p{N}").replace("{L}", r"\p{L}").replace("{N}", r"\p{N}"))

# Code points that the regex module's Unicode version counts as letters
# or numbers and that of the tokenizer library (an older one) does not.
NEWER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
    r"\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
    r"\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f"
    r"\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    r"\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2"
    r"\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed"
    r"\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    r"\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_OLD = {"{LN}": r"[\p{L}\p{N}--[NEWER]]", "{L}": r"[\p{L}--[NEWER]]", "{N}": r"[\p{N}--[NEWER]]"}
EXACT_PIECES = regex.compile(
    "(?V1)" + _PATTERN.replace("{LN}", _OLD["{LN}"]).replace("{L}", _OLD["{L}"]).replace("{N}", _OLD["{N}"]).replace("NEWER", NEWER)
)


# The same classes below U+0250, spelled out for the standard library's faster engine.
_LATIN = (r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0")
LATIN_PIECES = re.compile("'(?:[stmd]|re|ve|ll)| ?[{0}]+| ?[{1}]+| ?[^{0}{1}{2}]+|[{2}]+(?![^{2}])|[{2}]+".format(*_LATIN))
BEYOND_LATIN, MAYBE_NEWER = re.compile("[\u0250-\U0010ffff]"), re.compile("[\u0558-\U0010ffff]")


def pieces(text: str) -> list[str]:
    """What the library's pre-tokenizer splits an ordinary text into."""
    if not BEYOND_LATIN.search(text):
        return LATIN_PIECES.findall(text)
    return (EXACT_PIECES if MAYBE_NEWER.search(text) else PIECES).findall(text)


RUNS = regex.compile(r"\p{White_Space}{2,}(?=\P{White_Space})")
#: Pieces above this length are computed anew each time; at most so many are kept.
CACHED_CHARS, CACHED_PIECES = 64, 800_000
CUT_INSIDE = {"'re", "'ve", "'ll"}


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the
    rest takes the code points from 256 on, in byte order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Wide(Exception):
    """A change of count that one signed byte can't hold."""


class _Kept(dict):
    """A dict that fills itself by ``make`` and starts over when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece):
        value = self.make(piece)
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = value
        return value


class ByteBpe:
    """Symbols are numbered 0-255 for bytes and 256 + i for the result of merge i, so
    a smaller number is an earlier merge; ``ids`` maps them to the vocabulary's ids."""

    def __init__(self, file_json: str):
        spec = json.loads(file_json)
        vocab = spec["model"]["vocab"]
        back = {c: b for b, c in byte_alphabet().items()}
        raw = lambda s: bytes(back[c] for c in s)
        self.bytes_of = [bytes([b]) for b in range(256)]
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.number = {b: i for i, b in enumerate(self.bytes_of)}
        self.pair: dict[tuple[int, int], int] = {}
        self.ids = [vocab[byte_alphabet()[b]] for b in range(256)]
        for m in spec["model"]["merges"]:
            left, right = m.split(" ") if isinstance(m, str) else m
            a, b, new = self.number[raw(left)], self.number[raw(right)], len(self.bytes_of)
            self.pair[a, b] = new
            self.bytes_of.append(self.bytes_of[a] + self.bytes_of[b])
            self.number[self.bytes_of[-1]] = new
            self.parts.append((a, b))
            self.ids.append(vocab[left + right])
        self.longest = max(map(len, self.bytes_of))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = {i: b for i, b in zip(self.ids, self.bytes_of, strict=True)}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self._special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._fits: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self.deltas = _Kept(self._deltas)
        self.encoded = _Kept(lambda piece: self.merge(piece.encode()))

    def segments(self, text: str) -> list[str]:
        """Ordinary text and special strings in turn: [text, special, text, ...]."""
        if self._special_split is None or not any(s in text for s in self.special):
            return [text]
        return self._special_split.split(text)

    # -- encoding: a priority queue of merges over a doubly linked list of symbols --

    def symbols(self, data: bytes) -> list[int]:
        n = len(data)
        sym, nxt, prv = list(data), [*range(1, n), -1], list(range(-1, n - 1))
        pair = self.pair
        queue = [(rank, i) for i in range(n - 1) if (rank := pair.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = nxt[i] if sym[i] >= 0 else -1
            if j < 0 or pair.get((sym[i], sym[j])) != rank:
                continue  # stale: one of the two has been merged since
            sym[i], sym[j] = rank, -1
            nxt[i] = k = nxt[j]
            if k >= 0:
                prv[k] = i
                if (new := pair.get((rank, sym[k]))) is not None:
                    heapq.heappush(queue, (new, i))
            if (h := prv[i]) >= 0 and (new := pair.get((sym[h], rank))) is not None:
                heapq.heappush(queue, (new, h))
        return [s for s in sym if s >= 0]

    def merge(self, data: bytes) -> list[int]:
        return [self.ids[s] for s in self.symbols(data)]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.segments(text)):
            if k % 2:
                out.append(self.special[part])
            else:
                out.extend(chain.from_iterable(map(self.encoded.__getitem__, pieces(part))))
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")

    # -- counting: the last token of every prefix, by dynamic programming --

    def whole(self, t: int) -> bool:
        """Is symbol t what its own bytes encode to?"""
        if (known := self._whole.get(t)) is None:
            known = self._whole[t] = t < 256 or self.symbols(self.bytes_of[t]) == [t]
        return known

    def fits(self, a: int, b: int) -> bool:
        """Does the encoding of a's bytes then b's keep the boundary?  It does unless,
        while both sides are built, two symbols that meet at the boundary merge before
        either of them is merged away."""
        if (known := self._fits.get((a, b))) is not None:
            return known
        key, none = (a, b), 1 << 60
        # Symbols at the boundary, and the merge that ends each one's time there.
        a_ends, b_ends, keep = none, none, True
        while True:
            both = self.pair.get((a, b))
            # the left merge of equal rank comes first, as it starts further left
            if both is not None and both < a_ends and both <= b_ends:
                keep = False
                break
            if a < 256 and b < 256:
                break
            if a > b:  # the younger symbol was made last: step back before it
                a_ends, a = a, self.parts[a][1]
            else:
                b_ends, b = b, self.parts[b][0]
        if len(self._fits) > 1_000_000:
            self._fits.clear()
        self._fits[key] = keep
        return keep

    def prefix_counts(self, data: bytes) -> list[int]:
        """Token counts of the prefixes of one piece, at every byte.  The last token of
        a prefix is the one suffix that fits behind the last token of what precedes it."""
        n = len(data)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        get, known, longest = self.number.get, self._fits, self.longest
        for i in range(1, n + 1):
            for j in range(i - longest if i > longest else 0, i):
                t = get(data[j:i])
                if t is None or not self.whole(t):
                    continue
                if j:
                    fit = known.get((last[j], t))
                    if not (self.fits(last[j], t) if fit is None else fit):
                        continue
                last[i], count[i] = t, count[j] + 1
                break
        return count

    def _deltas(self, piece: str) -> bytes:
        """Change of the token count at each code point of a piece, one signed byte each."""
        data = piece.encode()
        count = self.prefix_counts(data)
        if len(data) != len(piece):
            count = [c for c, b in zip(count, data, strict=False) if b & 0xC0 != 0x80] + count[-1:]
        elif piece in CUT_INSIDE:
            count[2] = 2  # cut in the middle, such a piece is a quote and a letter
        change = [b - a for a, b in pairwise(count)]
        if max(change) > 127 or min(change) < -128:
            raise Wide
        return bytes([x & 255 for x in change])

    def _changes(self, found: list[str]) -> np.ndarray:
        try:
            return np.frombuffer(bytearray().join(map(self.deltas.__getitem__, found)), "i1").astype("<i4")
        except Wide:  # some piece's count jumps by more than a byte holds
            counts = []
            for p in found:
                lead = np.frombuffer(p.encode() + b" ", "u1") & 0xC0 != 0x80
                c = np.array(self.prefix_counts(p.encode()), "<i4")[lead]
                if p in CUT_INSIDE:
                    c[2] = 2
                counts.append(np.diff(c))
            return np.concatenate(counts)

    def _total(self, text: str) -> int:
        return int(self._changes(pieces(text)).sum()) if text else 0

    def prefix_table(self, text: str) -> np.ndarray:
        """Exact token counts of all prefixes of a text: entry i is for the first i code points."""
        found = [np.zeros(1, "<i4")]
        before = ""
        for k, part in enumerate(self.segments(text)):
            if k % 2:
                # cut inside, a special string is ordinary text behind the last piece
                tail = pieces(before)[-1:] if before else []
                tail = tail[0] if tail else ""
                held = self._total(tail)
                counts = [self._total(tail + part[:j]) - held for j in range(len(part))] + [1]
                found.append(np.diff(np.array(counts, "<i4")))
                continue
            before = part
            d = self._changes(pieces(part))
            for m in RUNS.finditer(part):
                # cut at its end, a run of white space is one piece; followed by text it gives up its last character
                run, e = m[0], m.end()
                off = self._total(run) - self._total(run[:-1]) - self._total(run[-1])
                if off:
                    d[e - 1] += off
                    d[e] -= off
            found.append(d)
        return np.cumsum(np.concatenate(found), dtype=np.int64)


_LOADED: dict[str, ByteBpe] = {}


#: Bytes of a vocabulary file that may be broadcast.
BROADCAST_BYTES = 64 << 20


def loaded(file_json: str) -> ByteBpe:
    """This worker's vocabulary for a file's content."""
    key = hashlib.sha256(file_json.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(file_json)
    return _LOADED[key]


def broadcast_file(spark, path: str):
    """The file's content on every executor; it is read by the driver, so its size is checked."""
    if (size := os.path.getsize(path)) > BROADCAST_BYTES:
        raise ValueError(f"a vocabulary file of {size} bytes is too large to broadcast")
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
