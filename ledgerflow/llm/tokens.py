"""Fast exact byte-level BPE over many texts: each distinct piece of text is encoded once a worker.

The public vocabulary's pattern splits a text into pieces that BPE never crosses. The split is done
here with array operations over many texts together; pieces are then told apart by 64-bit hashes,
and only those not seen before go to the tokenizer itself. Tests compare ids with the tokenizer's.
"""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers

from .common import mix64, prefix_hashes, range_hashes

VOCABULARY = "byte_bpe_50k.json"
#: Characters worked on at a time: bounds memory, also for very long texts.
CHUNK = 1 << 19
#: Pieces remembered by a worker; beyond it the memory starts anew.
REMEMBERED = 1 << 20

OTHER, LETTER, NUMBER, SPACE = range(4)
_QUOTE, _BLANK = 39, 32


def _char_classes() -> np.ndarray:
    import regex

    out = np.zeros(0x110000, np.uint8)
    all_of_them = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, all_of_them):
            lo, hi = ord(m[0][0]), ord(m[0][-1])
            out[lo : hi + 1] = kind
    return out


def _byte_alphabet(made: list[dict] = []) -> dict:  # noqa: B006
    """The vocabulary's printable character for each byte (a public, fixed mapping of byte-level BPE)."""
    if not made:
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        made.append({b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)})
    return made[0]


def split_starts(cps: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pieces start; begins: where each of the (not empty) texts in cps starts.

    The pattern, in order: a contraction; letters, numbers or others, each with one blank before
    it if there is one; white space, which leaves its last character to what follows it.
    """
    n = len(cps)
    first = np.zeros(n + 1, bool)
    first[begins] = True
    first[n] = True
    start = first[:n].copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    space = kinds == SPACE
    lead = space.copy()  # the last white space before something else in the same text
    lead[:-1] &= ~space[1:]
    lead[-1] = False
    lead &= ~first[1:]
    at = np.flatnonzero(lead)
    start[at] = True
    blank = at[cps[at] == _BLANK]
    start[blank + 1] = False  # the blank belongs to the piece after it
    quote = np.flatnonzero((cps == _QUOTE) & start)
    if len(quote):
        get = lambda k: np.where(_inside(first, quote, k), cps[np.minimum(quote + k, n - 1)], 0)
        a, b = get(1), get(2)
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = np.zeros(len(quote), bool)
        for x, y in ("re", "ve", "ll"):
            two |= (a == ord(x)) & (b == ord(y))
        for hit, k in ((one, 1), (two, 2)):
            q = quote[hit]
            start[q + 1] = False
            after = q + k + 1
            start[after[after < n]] = True
            last = after[after < n]
            # a blank that was to lead a piece still does; anything else now starts a piece itself
            start[last] = True
    return np.flatnonzero(start)


def _inside(first: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Whether at + k is in the same text as at."""
    ok = at + k < len(first) - 1
    for j in range(1, k + 1):
        ok &= ~first[np.minimum(at + j, len(first) - 1)]
    return ok


class Encoder:
    """Encodes texts to ids or counts of ids; special tokens' strings are ordinary text."""

    _by_path: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kinds = _char_classes()
        self.values = mix64(np.arange(1, 0x110001, dtype=np.uint64))
        self._forget()

    @classmethod
    def of(cls, name: str = VOCABULARY) -> Encoder:
        path = name if os.path.isabs(name) else str(public_tokenizers.path(name))
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def _forget(self) -> None:
        self.known: dict[int, int] = {}  # piece's hash to its place in known_at and known_n
        self.known_at = np.zeros(1 << 16, np.int64)  # where its ids begin in self.ids
        self.known_n = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, np.int32)
        self.used = 0

    def _learn(self, hashes: list[int], pieces: list[bytes]) -> None:
        alphabet, tokenize = _byte_alphabet(), self.tokenizer.model.tokenize
        got = [[t.id for t in tokenize(p.decode("latin-1").translate(alphabet))] for p in pieces]
        n = np.fromiter(map(len, got), np.int32, len(got))
        begin, total = len(self.known), int(n.sum())
        for name, least in (("known_at", begin + len(n)), ("known_n", begin + len(n)), ("ids", self.used + total)):
            if len(a := getattr(self, name)) < least:
                setattr(self, name, np.concatenate([a, np.zeros(max(least, len(a)), a.dtype)]))
        self.known_n[begin : begin + len(n)] = n
        self.known_at[begin : begin + len(n)] = self.used + np.cumsum(n) - n
        self.ids[self.used : self.used + total] = np.fromiter((i for x in got for i in x), np.int32, total)
        self.used += total
        self.known.update(zip(hashes, range(begin, begin + len(n))))

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For texts that are not empty: the known pieces in order, and where each text's begin."""
        cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(lengths) - lengths
        starts = split_starts(cps, self.kinds[cps], begins)
        ends = np.append(starts[1:], len(cps))
        hashes = mix64(range_hashes(prefix_hashes(self.values[cps]), starts, ends) + (ends - starts).astype(np.uint64))
        seen, where, index = np.unique(hashes, return_index=True, return_inverse=True)
        seen = seen.tolist()
        if len(self.known) > REMEMBERED:
            self._forget()
        if new := [k for k, h in enumerate(seen) if h not in self.known]:
            joined = cps.tobytes()
            cut = lambda i: joined[4 * starts[i] : 4 * ends[i]].decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            self._learn([seen[k] for k in new], [cut(where[k]) for k in new])
        at = np.fromiter(map(self.known.__getitem__, seen), np.int64, len(seen))
        return at[index], np.searchsorted(starts, begins)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """int32 ids of each text."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for owners, parts in _parts(texts):
            known, begins = self._chunk(parts)
            n, at = self.known_n[known].astype(np.int64), self.known_at[known]
            upto = np.cumsum(n)
            ids = self.ids[np.repeat(at - upto + n, n) + np.arange(int(upto[-1]))]
            cuts = np.append(upto, 0)[begins - 1]
            cuts[0] = 0
            for owner, a, b in zip(owners, cuts, [*cuts[1:], len(ids)]):
                out[owner].append(ids[a:b])
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.int32) for x in out]

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        out = np.zeros(len(texts), np.int64)
        for owners, parts in _parts(texts):
            known, begins = self._chunk(parts)
            np.add.at(out, owners, np.add.reduceat(self.known_n[known].astype(np.int64), begins))
        return out


def _parts(texts: list[str]):
    """(owner indices, texts) of about CHUNK characters; longer texts are cut where a piece starts."""
    owners: list[int] = []
    parts: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        for part in _cut(text):
            if size and size + len(part) > CHUNK:
                yield np.array(owners), parts
                owners, parts, size = [], [], 0
            owners.append(i)
            parts.append(part)
            size += len(part)
    if parts:
        yield np.array(owners), parts


def _cut(text: str):
    """text in parts of about CHUNK characters: a blank between two letters always starts a piece."""
    import re

    begin = 0
    while len(text) - begin > 2 * CHUNK:
        m = re.compile(r"[A-Za-z](?= [A-Za-z])").search(text, begin + CHUNK)
        if not m:
            break
        yield text[begin : m.end()]
        begin = m.end()
    if begin < len(text):
        yield text[begin:] if begin else text
