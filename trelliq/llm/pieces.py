"""Encoding and decoding by the model file of a BPE with word marks and byte fallback, merges done in numpy rounds."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import spread
from .common import gather, small_batches, text_slices, tidy
from .tokens import Lookup

#: U+2581, which stands for a space in pieces.
MARK = "▁"
#: Kinds of pieces in model files.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MEMORY = 300_000
#: Words of more symbols than this are merged rank by rank, all occurrences of a rank at once.
LONG_WORD = 256


def read_model(path: str) -> dict:
    """Pieces, scores, kinds and the settings that matter, read from the model's wire format."""
    from sentencepiece import SentencePieceProcessor

    held = SentencePieceProcessor(model_file=path)
    n = held.get_piece_size()
    kinds = [CONTROL if held.is_control(i) else UNKNOWN if held.is_unknown(i) else BYTE if held.is_byte(i) else UNUSED if held.is_unused(i) else NORMAL for i in range(n)]
    return {"pieces": [held.id_to_piece(i) for i in range(n)], "scores": [held.get_score(i) for i in range(n)], "kinds": kinds, "bos": held.bos_id(), "eos": held.eos_id(), "unk": held.unk_id()}


class PieceModel:
    """Vectorised BPE: all distinct words of a batch are merged together, one merge a word and round.

    A round takes in every word its pair of best score (leftmost between equals), merges it, and closes the gap; words
    without a pair leave. This is the order in which the library's queue merges, so the ids are the same. Spaces become
    marks and one is put in front of a text. Pieces hold marks only at their start, so a run of marks with what
    follows it is a word, and merges never cross words.
    """

    def __init__(self, path: str):
        m = read_model(path)
        self.bos, self.eos, self.unk = m["bos"], m["eos"], m["unk"]
        kinds, pieces = np.array(m["kinds"]), m["pieces"]
        normal = {p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in normal) or (kinds == UNUSED).any():
            raise ValueError("a piece with a mark behind its start, or an unused one: words can't be merged apart")
        # symbols: pieces by id; single characters that are no piece get numbers above, by code point
        self.size = len(pieces)
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.byte_id = np.zeros(256, np.int64)
        for i in np.flatnonzero(kinds == BYTE):
            self.byte_id[int(pieces[i][3:5], 16)] = i
        # order of merges: by score, best first; equal scores are one rank
        scores = np.array(m["scores"])
        rank_of = {s: r for r, s in enumerate(sorted({s for s, k in zip(scores, kinds, strict=True) if k == NORMAL}, reverse=True))}
        left, right, into = [], [], []
        for p, i in normal.items():
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                ia, ib = self._symbol(a, normal), self._symbol(b, normal)
                if ia is not None and ib is not None:
                    left.append(ia), right.append(ib), into.append(i)
        key = np.array(left, np.uint64) << np.uint64(32) | np.array(right, np.uint64)
        into_ = np.array(into, np.int64)
        rank = np.array([rank_of[scores[i]] for i in into], np.int64)
        # open addressing: a pair's slot by its mixed key; empty slots hold the largest number
        bits = max(4, int(np.ceil(np.log2(len(key) + 1))) + 2)
        self.mask = np.uint64((1 << bits) - 1)
        self.slot_key = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64)
        self.slot_val = np.zeros(1 << bits, np.int64)
        self.probes = 0
        todo, at = np.arange(len(key)), self._slot(key)
        while len(todo):
            self.probes += 1
            free = self.slot_key[at] == np.iinfo(np.uint64).max
            _, first = np.unique(at, return_index=True)
            win = np.zeros(len(todo), bool)
            win[first] = True
            win &= free
            self.slot_key[at[win]] = key[todo[win]]
            self.slot_val[at[win]] = rank[todo[win]] << 20 | into_[todo[win]]
            todo, at = todo[~win], (at[~win] + np.uint64(1)) & self.mask
        # decoding: each id's bytes
        out = [b"" if k in (CONTROL,) else b" \xe2\x81\x87 " if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.out_size = np.array([len(x) for x in out], np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.is_byte = kinds == BYTE
        # bytes below 0x80 are characters by themselves (a space might be taken for the mark in front): nothing to look into
        self.is_odd = np.array([k == BYTE and (x[0] >= 0x80 or x == b" ") for k, x in zip(kinds, out, strict=True)])
        self.known = Lookup(MEMORY)

    def _symbol(self, text: str, normal: dict[str, int]) -> int | None:
        """A piece's id; of a single character that is no piece, a number above all ids."""
        found = normal.get(text)
        return found if found is not None else self.size + ord(text) if len(text) == 1 else None

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = key * np.uint64(0x9E3779B97F4A7C15)
            return (x ^ (x >> np.uint64(32))) & self.mask

    NONE = np.int64(1 << 60)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 20 | merged id of each pair, NONE where it doesn't merge."""
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = self._slot(key)
        out = np.full(len(key), self.NONE, np.int64)
        todo = np.arange(len(key))
        for _ in range(self.probes):
            held = self.slot_key[at]
            hit = held == key[todo]
            out[todo[hit]] = self.slot_val[at[hit]]
            on = ~hit & (held != np.iinfo(np.uint64).max)
            todo, at = todo[on], (at[on] + np.uint64(1)) & self.mask
            if not len(todo):
                break
        return out

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges words given as flat symbols and the words' sizes (none empty); (flat symbols, sizes)."""
        done_sym: list[np.ndarray] = []
        done_size: list[np.ndarray] = []
        done_word: list[np.ndarray] = []
        word = np.arange(len(sizes))
        symbols, sizes = symbols.astype(np.int64), sizes.astype(np.int64)
        if not len(sizes):
            return symbols, sizes
        ends = np.cumsum(sizes)
        value = np.full(len(symbols), self.NONE, np.int64)  # of the pair that begins at a symbol; a word's last has none
        if len(symbols) > 1:
            value[:-1] = self._pair(symbols[:-1], symbols[1:])
        value[ends - 1] = self.NONE
        while len(sizes):
            starts = ends - sizes
            best = np.minimum.reduceat(value >> 20, starts)
            live = best < (self.NONE >> 20)
            if not live.all():
                over = np.repeat(~live, sizes)
                done_sym.append(symbols[over]), done_size.append(sizes[~live]), done_word.append(word[~live])
                symbols, value, sizes, word, best = symbols[~over], value[~over], sizes[live], word[live], best[live]
                if not len(sizes):
                    break
                ends = np.cumsum(sizes)
                starts = ends - sizes
            hits = np.flatnonzero((value >> 20) == np.repeat(best, sizes))
            # the leftmost of each word: hits are in order, so each word's first
            spot = hits[np.searchsorted(hits, starts)]
            symbols[spot] = value[spot] & 0xFFFFF
            keep = np.ones(len(symbols), bool)
            keep[spot + 1] = False
            symbols, value, sizes = symbols[keep], value[keep], sizes - 1
            spot = spot - np.arange(len(spot))
            ends = np.cumsum(sizes)
            starts = ends - sizes
            last = spot == ends - 1
            value[spot] = self.NONE
            a = spot[~last]
            value[a] = self._pair(symbols[a], symbols[a + 1])
            b = spot[spot > starts]
            value[b - 1] = self._pair(symbols[b - 1], symbols[b])
        flat, size, at = np.concatenate(done_sym), np.concatenate(done_size), np.concatenate(done_word)
        order = np.argsort(at)
        begin = np.cumsum(size) - size
        return flat[gather(begin[order], size[order])], size[order]

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Merges one long word: the pairs of the best rank, leftmost first, all at once where that changes nothing.

        Merging them one after the other would differ only if a merge made a pair of an equal or better rank, which
        would have to go first. Each round looks at the pairs it makes, those between merges included; from the first
        merge that makes such a pair on, what is left of the round waits for its turn. Symbols are linked to their
        neighbours and never moved, so a round costs what it merges; ranks wait in a heap, each with its places.
        """
        symbols = symbols.astype(np.int64)
        n = len(symbols)
        before, after = np.arange(-1, n - 1), np.append(np.arange(1, n), -1)
        value = np.append(self._pair(symbols[:-1], symbols[1:]), self.NONE)  # of the pair that begins at a symbol
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(at: np.ndarray) -> None:
            at = at[value[at] < self.NONE]
            if not len(at):
                return
            ranks = value[at] >> 20
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.concatenate([[0], np.flatnonzero(ranks[1:] != ranks[:-1]) + 1, [len(at)]]).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                r = int(ranks[a])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(heap, r)
                waiting[r].append(at[a:b])

        def pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            """Values of the pairs (symbol, symbol); -1 stands for no symbol."""
            out = np.full(len(left), self.NONE, np.int64)
            ok = (left >= 0) & (right >= 0)
            out[ok] = self._pair(left[ok], right[ok])
            return out

        def symbol(at: np.ndarray) -> np.ndarray:
            return np.where(at >= 0, symbols[at], -1)

        wait(np.arange(n - 1))
        while heap:
            rank = heapq.heappop(heap)
            spots = np.unique(np.concatenate(waiting.pop(rank)))
            spots = spots[value[spots] >> 20 == rank]  # those that still stand
            if not len(spots):
                continue
            # of pairs that share a symbol the leftmost goes first: in a chain of them every second one
            chained = np.zeros(len(spots), bool)
            chained[1:] = after[spots[:-1]] == spots[1:]
            head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(spots))))
            take = spots[(np.arange(len(spots)) - head) % 2 == 0]
            made = value[take] & 0xFFFFF
            left, second = before[take], after[take]
            right = after[second]
            # pairs that come up as merges go on from left to right: the symbol before is merged by then, the one behind isn't yet
            merged_left = np.zeros(len(take), bool)
            merged_left[1:] = left[1:] == second[:-1]
            lefts = symbol(left)
            lefts[1:][merged_left[1:]] = made[:-1][merged_left[1:]]
            new_left, new_right = pair(lefts, made), pair(made, symbol(right))
            early = (np.minimum(new_left, new_right) >> 20) <= rank
            upto = len(take)
            if early.any():
                upto = int(early.argmax()) + 1
                rest = spots[spots > take[upto - 1]]
                take, made, left, second, right = take[:upto], made[:upto], left[:upto], second[:upto], right[:upto]
            else:
                rest = spots[:0]
            symbols[take] = made
            value[second] = self.NONE
            symbols[second] = -1
            after[take] = right
            before[right[right >= 0]] = take[right >= 0]
            # neighbours may be merged ones themselves: read them anew
            left = before[take]
            now = np.unique(np.concatenate([take, left[left >= 0]]))
            value[now] = pair(symbols[now], symbol(after[now]))
            wait(now)
            if len(rest):
                wait(rest)
        return symbols[symbols >= 0]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and sizes of distinct words (marks in place)."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.char_id[codes].astype(np.int64)
        symbols = np.where(ids >= 0, ids, self.size + codes.astype(np.int64))
        long = np.flatnonzero(sizes > LONG_WORD)
        if len(long):
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            apart = {int(i): self.merge_long(symbols[bounds[i] : bounds[i + 1]]) for i in long}
            short = sizes <= LONG_WORD
            flat, size = self.merge(symbols[np.repeat(short, sizes)], sizes[short])
            cuts, next_ = np.concatenate([[0], np.cumsum(size)]), np.cumsum(short) - 1
            parts = [apart[i] if i in apart else flat[cuts[next_[i]] : cuts[next_[i] + 1]] for i in range(len(sizes))]
            symbols, sizes = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        else:
            symbols, sizes = self.merge(symbols, sizes)
        alone = np.flatnonzero(symbols >= self.size)  # a character that is no piece: its bytes
        if not len(alone):
            return symbols, sizes
        raw = [np.frombuffer(chr(c).encode("utf-8", "replace"), np.uint8) for c in (symbols[alone] - self.size).tolist()]
        width = np.ones(len(symbols), np.int64)
        width[alone] = [len(x) for x in raw]
        out = np.repeat(symbols, width)
        begin = np.cumsum(width) - width
        out[gather(begin[alone], width[alone])] = self.byte_id[np.concatenate(raw)]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        return out, np.bincount(owner, weights=width, minlength=len(sizes)).astype(np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids without begin and end, offsets of each text's ids) of texts given as UTF-8 bytes."""
        n = len(data)
        count = np.diff(offsets)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        # a word begins at a space (or mark) after another character, and where a text begins
        marked = data == 0x20
        real = np.zeros(n, bool)  # the three bytes of a mark that stands in the text itself
        m = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if n > 2 else np.zeros(0, np.int64)
        real[m] = real[m + 1] = real[m + 2] = True
        head = marked.copy()
        head[m] = True
        either = marked | real
        cut = np.zeros(n, bool)
        cut[1:] = head[1:] & ~either[:-1]
        full = offsets[:-1][count > 0]
        cut[full] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        first = np.zeros(n, bool)
        first[full] = True
        lead = first[starts]  # gets a mark in front
        raw = data.tobytes()

        def make(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[rows].tolist(), ends[rows].tolist(), strict=True)]
            return self._words([(MARK + w if f else w).replace(" ", MARK) for w, f in zip(words, lead[rows].tolist(), strict=True)])

        ids, size = self.known.resolve(data, starts, ends, np.where(lead, np.uint64(0xA5A5A5A5A5A5A5A5), np.uint64(0)), make)
        ids = ids.astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(size)])
        return ids, sums[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Texts of id sequences, in UTF-8: the mark in front goes, bytes that begin no character become U+FFFD byte by byte."""
        size = self.out_size[ids]
        flat = self.out[gather(self.out_start[ids], size)]
        sums = np.concatenate([[0], np.cumsum(size)])
        bounds = sums[offsets]
        by_bytes = np.concatenate([[0], np.cumsum(self.is_odd[ids])])[offsets]
        raw = flat.tobytes()
        out = []
        for i in range(len(offsets) - 1):
            if by_bytes[i + 1] > by_bytes[i]:
                out.append(self._decode_bytes(ids[offsets[i] : offsets[i + 1]]))
                continue
            text = raw[bounds[i] : bounds[i + 1]]
            out.append(text[1:] if text[:1] == b" " else text)
        return out

    def _decode_bytes(self, ids: np.ndarray) -> bytes:
        """A sequence with byte pieces: each run of them is read as UTF-8, a byte that begins no character is U+FFFD."""
        out, i, first = [], 0, True
        while i < len(ids):
            if not self.is_byte[ids[i]]:
                piece = self.out[self.out_start[ids[i]] : self.out_start[ids[i]] + self.out_size[ids[i]]].tobytes()
                out.append(piece[1:] if first and piece[:1] == b" " else piece)
                first = first and not self.out_size[ids[i]]
                i += 1
                continue
            j = i
            while j < len(ids) and self.is_byte[ids[j]]:
                j += 1
            run = self.out[self.out_start[ids[i:j]]].tobytes()
            k = 0
            while k < len(run):
                for width in (1, 2, 3, 4):
                    try:
                        run[k : k + width].decode()
                    except UnicodeDecodeError:
                        continue
                    if k + width <= len(run):
                        out.append(run[k : k + width])
                        k += width
                        break
                else:
                    out.append("�".encode())
                    k += 1
            first, i = False, j
        return b"".join(out)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model a worker process."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row; begin and end ids included. For readers of the ids themselves."""
    return _mapped(docs, model_path, id_col, text_col, False)


def digest_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of ``docs``.

    Null texts are empty: begin and end id alone. Repeated rows are encoded each; an empty table gives an empty
    result; only the id and text columns are read. No shuffle; slices of a batch bound the memory, and a longer text
    is a slice alone. Words of any length are merged whole.
    """
    return _mapped(docs, model_path, id_col, text_col, True)


def _mapped(docs: DataFrame, model_path: str, id_col: str, text_col: str, digest: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                ids, at = m.encode(data, offsets)
                n = b - a
                sizes = np.diff(at) + 2
                bounds = np.concatenate([[0], np.cumsum(sizes)])
                full = np.empty(int(bounds[-1]), np.int64)
                inner = np.ones(len(full), bool)
                inner[bounds[:-1]] = inner[bounds[1:] - 1] = False
                full[inner] = ids
                full[bounds[:-1]], full[bounds[1:] - 1] = m.bos, m.eos
                texts = m.decode(full, bounds)
                key = batch.column(0).slice(a, n)
                if digest:
                    raw, cut = full.astype("<u4").tobytes(), (bounds * 4).tolist()
                    shas = [hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(cut, cut[1:], strict=False)]
                    yield pa.RecordBatch.from_arrays([key, pa.array(sizes), pa.array(shas), pa.array([hashlib.sha256(t).hexdigest() for t in texts])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(full, pa.int32()))
                    yield pa.RecordBatch.from_arrays([key, lists, pa.array([t.decode() for t in texts])], ["doc_id", "ids", "decoded"])

    small_batches(docs.sparkSession)
    kept = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return kept.mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded string")
