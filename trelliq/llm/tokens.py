"""Whole-text tokenisation by the vocabulary file of a byte-level BPE, each distinct chunk of a batch encoded once."""

from __future__ import annotations

from itertools import chain

import numpy as np

from .common import gather, run_hashes

#: Distinct chunks that a worker remembers from batch to batch; beyond it the memory starts anew (results don't change).
MEMORY = 300_000
#: Bytes of chunks that a worker remembers.
MEMORY_BYTES = 16 << 20


def _classes() -> np.ndarray:
    """ASCII bytes by class: 1 letter, 2 punctuation that may be cut before, 4 any visible character."""
    out = np.zeros(256, np.uint8)
    for c in range(0x21, 0x7F):
        out[c] = 4 | (1 if chr(c).isalpha() else 0) | (2 if not chr(c).isalnum() and chr(c) not in "'|" else 0)
    return out


CLASSES = _classes()


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut so that no pre-token of a byte-level BPE, and no special token, spans the cut.

    Cuts stand before white space (space or line feed) after a character that isn't white space, where a pre-token always
    starts, the look-ahead of white-space runs then ends at the cut as it would at the next character; before punctuation
    (not ``'``, which may start a contraction, nor ``|``, which stands in special tokens) after an ASCII letter; and
    after a line feed alone between visible ASCII characters. A byte that may end a wide white space is no visible
    character, so a chunk may be longer than needed, never shorter.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    kind = CLASSES[data]
    solid = kind >= 4  # certainly no white space
    high = data >= 0x80
    if high.any():
        wide = np.zeros(n, bool)
        wide[1:] = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        wide[2:] |= (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)
        solid |= high & ~wide
    cut = np.zeros(n, bool)
    space = (data == 0x20) | (data == 0x0A)
    cut[1:] = (space[1:] & solid[:-1]) | ((kind[1:] & 2) > 0) & ((kind[:-1] & 1) > 0)
    cut[2:] |= (kind[2:] >= 4) & (data[1:-1] == 0x0A) & (kind[:-2] >= 4)
    cut[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(cut)


class Lookup:
    """Ids of byte runs, remembered from batch to batch. Runs are found by their hashes and held against the bytes they stand for."""

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        #: Of each run: where its ids and its bytes are, and its length with its kind.
        self.starts, self.sizes, self.raw_starts, self.kinds = (np.zeros(0, np.int64) for _ in range(4))
        self.ids, self.raw = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def _add(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray, kind: np.ndarray) -> None:
        every = np.concatenate([self.hashes, hashes])
        order = np.argsort(every, kind="stable")
        self.hashes = every[order]
        new = {"starts": len(self.ids) + np.cumsum(sizes) - sizes, "sizes": sizes, "raw_starts": len(self.raw) + np.cumsum(length) - length, "kinds": kind}
        for name, more in new.items():
            setattr(self, name, np.concatenate([getattr(self, name), more])[order])
        self.ids = np.concatenate([self.ids, ids])
        self.raw = np.concatenate([self.raw, data[gather(begin, length)]])

    def resolve(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray | None, make) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of all runs, one after the other. The runs cover ``data``, in order.

        ``make(rows)`` gives the flat ids and sizes of the runs ``rows``. ``salt`` tells equal runs apart that have
        different ids. A run whose hash is that of other bytes is made by itself; runs of one length of up to eight bytes
        have hashes of their own, so bytes are compared for longer ones only.
        """
        hashes = run_hashes(data, starts, ends)
        length = ends - starts
        kind = length << 1 | (salt != 0 if salt is not None else 0)
        if salt is not None:
            hashes ^= salt
        distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)

        def missing() -> np.ndarray:
            if not len(self.hashes):
                return np.ones(len(distinct), bool)
            return self.hashes[np.minimum(np.searchsorted(self.hashes, distinct), len(self.hashes) - 1)] != distinct

        new = missing()
        if len(self.hashes) + int(new.sum()) > self.most or len(self.raw) > MEMORY_BYTES:
            self.clear()
            new[:] = True
        if new.any():
            pick = first[new]
            ids, sizes = make(pick)
            self._add(distinct[new], sizes, ids.astype(np.uint32), data, starts[pick], length[pick], kind[pick])
        at = np.searchsorted(self.hashes, distinct)[place]
        where, size = self.starts[at], self.sizes[at]
        odd = self.kinds[at] != kind
        long = np.flatnonzero(~odd & (length > 8))
        if len(long):
            n = length[long]
            same = self.raw[gather(self.raw_starts[at[long]], n)] == data[gather(starts[long], n)]
            odd[long] = ~np.logical_and.reduceat(same, np.cumsum(n) - n)
        held = self.ids
        if odd.any():
            rows = np.flatnonzero(odd)
            ids, sizes = make(rows)
            where, size = where.copy(), size.copy()
            where[rows], size[rows] = len(held) + np.cumsum(sizes) - sizes, sizes
            held = np.concatenate([held, ids.astype(np.uint32)])
        return held[gather(where, size)], size


def _byte_of_letter() -> dict[str, int]:
    """The visible letters by which vocabulary files of byte-level BPEs write bytes: visible bytes as they are, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Pre-tokens of the byte-level BPE: contractions, letters, digits, other characters, white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """encode(): ids of each text as ``tokenizers`` gives them for it with add_special_tokens=False.

    ``path`` is the vocabulary file of the ``tokenizers`` library. Distinct chunks are encoded by tiktoken with the same
    vocabulary, which takes a fifth of the time for chunks this short; tests hold the ids against ``tokenizers``.
    """

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        byte = _byte_of_letter()
        special = {t["content"]: t["id"] for t in held["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in held["model"]["vocab"].items() if token not in special}
        self.core = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)._core_bpe
        self.special = {*special}
        self.largest = max([*ranks.values(), *special.values()])
        self.known = Lookup(MEMORY)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text's ids) of texts given as UTF-8 bytes and offsets."""
        starts = chunk_starts(data, offsets)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        raw = data.tobytes()

        def make(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            core, special = self.core.encode, self.special
            got = [core(raw[a:b].decode("utf-8", "replace"), special) for a, b in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

        ids, size = self.known.resolve(data, starts, ends, None, make)
        sums = np.concatenate([[0], np.cumsum(size)])
        return ids, sums[np.searchsorted(starts, offsets)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
