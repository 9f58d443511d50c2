"""Language identification: scripts narrow the candidates, then Viterbi over per-word scores labels spans.

A word's score for a language is the sum of log-likelihoods of its byte bigrams and 4-grams, learnt from labelled
documents. Languages that were hardly seen in a word's script are no candidates for it. The best path over a document's
words, with a penalty for each switch, labels spans; the document's language is the one with most letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold, map_text, small_batches, text_slices

#: Labelled documents that the models see at most, about: a bounded sample by a hash of the id.
TRAIN_DOCS = 4000
#: Of each language at least so many, or all that it has.
TRAIN_EACH = 200
BITS = 17
#: Pseudo-count of every gram.
ALPHA = 0.3
#: Natural-log cost of a switch of language between neighbouring words.
SWITCH = 12.0
#: A language whose training letters are rarer than this in a script is no candidate there.
SHARE = 0.01
SPACE = 0x20
#: Scripts by the first byte of their letters in UTF-8; a lead byte tells them apart well enough to narrow candidates.
SCRIPTS = ((0xC3, 0xC9, 0), (0xCA, 0xCD, 0), (0xCE, 0xCF, 1), (0xD0, 0xD4, 2), (0xD5, 0xD6, 3), (0xD7, 0xD7, 4), (0xD8, 0xDB, 5), (0xDC, 0xDF, 6), (0xE0, 0xE0, 7), (0xE1, 0xE1, 8), (0xE3, 0xE3, 9), (0xE4, 0xE9, 10), (0xEA, 0xED, 11), (0xF0, 0xF4, 12))
SCRIPT_COUNT = 13


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower case of bytes, whether a byte can be part of a letter, the script of lead bytes (-1: none)."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    letter[0x80:] = True
    script = np.full(256, -1, np.int64)
    script[65:91] = script[97:123] = 0
    for a, b, k in SCRIPTS:
        script[a : b + 1] = k
    return low, letter, script


LOW, LETTER, SCRIPT = _tables()


def _folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with letters in lower case and all else a space; which bytes are letters."""
    letter = LETTER[data]
    if letter.any() and (data >= 0x80).any():
        at = np.flatnonzero((data[:-1] == 0xC2) | ((data[:-1] == 0xE2) & (data[1:] <= 0x83)))  # signs and punctuation outside ASCII
        letter[at] = False
        letter[at + 1] = False
        three = at[data[at] == 0xE2] + 2
        letter[three[three < len(data)]] = False
    out = np.where(letter, LOW[data], np.uint8(SPACE))
    if len(data) > 1:  # capital letters of Latin-1: C3 80..C3 9E
        big = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][big] += 0x20
    return out, letter


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the bigram and of the 4-gram that end at each byte, and whether the byte is a letter. Texts don't run together."""
    out, letter = _folded(data)
    ends = offsets[:-1][(offsets[:-1] > 0) & (offsets[:-1] < len(data))]
    wide = np.full(len(out) + 3, SPACE, np.uint32)
    wide[3:] = out
    two = wide[2:-1] << np.uint32(8) | wide[3:]
    four = wide[:-3] << np.uint32(24) | wide[1:-2] << np.uint32(16) | two
    for k in range(3):  # what stands before a text's first bytes is a space
        at = ends + k
        at = at[at < len(data)]
        keep = np.uint32((1 << (8 * (k + 1))) - 1)
        spaces = np.uint32(0x20202020) & ~keep
        four[at] = four[at] & keep | spaces
        if k == 0:
            two[at] = two[at] & np.uint32(0xFF) | np.uint32(0x2000)
    with np.errstate(over="ignore"):
        return two.astype(np.int64), ((four * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64), letter


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of words (runs of bytes that are no ASCII white space; white space goes with the word before) and each text's first word's number."""
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    begin = np.zeros(len(data), bool)
    begin[1:] = ~white[1:] & white[:-1]
    begin[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(begin)
    return starts, np.searchsorted(starts, offsets)


@dataclass
class LanguageModel:
    langs: list[str]
    two: np.ndarray
    four: np.ndarray
    #: Candidates by script: script x language.
    able: np.ndarray

    def word_scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words x languages, letters of each word, each text's first word)."""
        starts, first = _words(data, offsets)
        if not len(starts):
            return np.zeros((0, len(self.langs)), np.float32), np.zeros(0, np.int64), first
        two, four, letter = _grams(data, offsets)
        each = self.two[two]
        each += self.four[four]
        each[~letter] = 0
        scores = np.add.reduceat(each, starts, axis=0)
        letters = np.add.reduceat(letter.astype(np.int64), starts)
        far = np.flatnonzero(letter & (SCRIPT[data] > 0))  # letters of another script than Latin
        if len(far):
            word = np.searchsorted(starts, far, side="right") - 1
            for k in np.unique(SCRIPT[data[far]]):
                own = np.unique(word[SCRIPT[data[far]] == k])
                if self.able[k].any():
                    scores[np.ix_(own, np.flatnonzero(~self.able[k]))] -= np.float32(4 * SWITCH)
        if not self.able[0].all() and self.able[0].any():
            own = np.unique(np.searchsorted(starts, np.flatnonzero(letter & (SCRIPT[data] == 0) & (data < 0x80)), side="right") - 1)
            scores[np.ix_(own, np.flatnonzero(~self.able[0]))] -= np.float32(4 * SWITCH)
        return scores, letters, first

    def paths(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best language of every word. Texts go in step, longest first, so each step is one array operation."""
        k = scores.shape[1]
        counts = np.diff(first)
        order = np.argsort(-counts, kind="stable")
        head, counts = first[:-1][order], counts[order]
        path = np.zeros(len(scores), np.int64)
        if not len(scores) or k == 1:
            return path
        stays = np.zeros((len(scores), k), bool)  # whether a word's language is that of the word before
        from_ = np.zeros(len(scores), np.int64)  # else the best language of the word before
        live = int((counts > 0).sum())
        at = head[:live].copy()
        value = scores[at].astype(np.float64)
        last = np.zeros(live, np.int64)
        t = 1
        while True:
            now = int(np.searchsorted(-counts, -t, side="left"))  # texts with more than t words
            last[now:live] = value[now:live].argmax(1)
            if not now:
                break
            value, at, live = value[:now], at[:now] + 1, now
            top = value.argmax(1)
            jump = value[np.arange(now), top] - SWITCH
            keep = value >= jump[:, None]
            stays[at], from_[at] = keep, top
            value = np.where(keep, value, jump[:, None]) + scores[at]
            t += 1
        # back: from each text's last word
        state = last
        at = head[: len(state)] + counts[: len(state)] - 1
        left = counts[: len(state)].copy()
        while len(at):
            path[at] = state
            on = left > 1
            if not on.all():
                at, state, left = at[on], state[on], left[on]
                if not len(at):
                    break
            state = np.where(stays[at, state], state, from_[at])
            at, left = at - 1, left - 1
        return path

    def label(self, texts: pa.Array, spans: bool = False) -> list[pa.Array]:
        """[lang_pred, score] of each text, and with ``spans`` its spans."""
        scores, letters, firsts, base = [], [], [np.zeros(1, np.int64)], 0
        for _, _, data, offsets in text_slices(texts, 1 << 20):
            s, n, first = self.word_scores(data, offsets)
            scores.append(s), letters.append(n), firsts.append(first[1:] + base)
            base += len(s)
        first = np.concatenate(firsts)
        k = len(self.langs)
        count = len(first) - 1
        if not k:
            none = [pa.array(["und"] * count, pa.string()), pa.array(np.zeros(count))]
            return [*none, pa.array([[]] * count, SPANS)] if spans else none
        score = np.concatenate(scores) if scores else np.zeros((0, k), np.float32)
        letter = np.concatenate(letters) if letters else np.zeros(0, np.int64)
        path = self.paths(score, first)
        doc = np.repeat(np.arange(count), np.diff(first))
        by = np.bincount(doc * k + path, weights=letter, minlength=count * k).reshape(count, k)
        total = by.sum(1)
        top = by.argmax(1)
        share = by.max(1) / np.maximum(total, 1) if count else np.zeros(0)
        # no letter: bytes outside ASCII leave a doubt, so the characters decide wherever no ASCII letter stands
        blank = total == 0
        sure = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), True).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(~sure).tolist():
            blank[i] = not any(c.isalpha() for c in texts[i].as_py())
        names = [*self.langs, "und"]
        out = [pa.array([names[i] for i in np.where(blank, k, top)], pa.string()), pa.array(np.where(blank, 0.0, np.clip(share, 0, 1)))]
        if spans:
            edge = np.ones(len(path), bool)
            edge[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
            start = np.flatnonzero(edge)
            size = np.diff(np.append(start, len(path)))
            cuts = np.searchsorted(start, first).astype(np.int32)
            held = pa.StructArray.from_arrays([pa.array([self.langs[i] for i in path[start]], pa.string()), pa.array((start - first[doc[start]]).astype(np.int32)), pa.array(size.astype(np.int32))], ["lang", "first_word", "words"])
            out.append(pa.ListArray.from_arrays(pa.array(cuts), held))
        return out


SPANS = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int32()), ("words", pa.int32())]))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hold: int = 4, held: int = 2) -> LanguageModel:
    """Learns from rows with a text and a language whose crc32(id as text) mod ``hold`` isn't ``held``, from about ``train_docs`` at most,
    but ``TRAIN_EACH`` of each language: a rare one is learned at every size of the table.

    Each partition of the sample sums its counts; the driver adds a bounded number of them up. Without such rows there
    is no language and every text is ``und``.
    """
    scratch = Scratch(docs.sparkSession, "langid")
    small_batches(docs.sparkSession)
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col, hold) != held))
    counts = {r["lang"]: r["n"] for r in known.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}  # a row a language
    rows = sum(counts.values())
    if rows > train_docs:
        upto = {lang: int((1 << 30) * min(1, max(train_docs / rows, TRAIN_EACH / n))) for lang, n in counts.items()}
        known = known.filter(F.pmod(F.xxhash64(F.lit(7919), F.col(id_col)), F.lit(1 << 30)) < F.create_map(*[F.lit(x) for pair in upto.items() for x in pair])[F.col(lang_col).cast("string")])
    sample = scratch.keep(known.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")), "sample").coalesce(4)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            for a, b, data, offsets in text_slices(batch.column(1)):
                two, four, letter = _grams(data, offsets)
                here = np.repeat(langs[a:b], np.diff(offsets))
                script = SCRIPT[data]
                for lang in set(langs[a:b].tolist()):
                    own = letter & (here == lang)
                    kept = sums.setdefault(lang, [np.zeros(1 << 16), np.zeros(1 << BITS), np.zeros(SCRIPT_COUNT)])
                    kept[0] += np.bincount(two[own], minlength=1 << 16)
                    kept[1] += np.bincount(four[own], minlength=1 << BITS)
                    kept[2] += np.bincount(script[own & (script >= 0)], minlength=SCRIPT_COUNT)
        for lang, kept in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang]), *[pa.array([x.astype(np.float32).tobytes()], pa.binary()) for x in kept]], ["lang", "two", "four", "script"])

    rows = sample.mapInArrow(count, "lang string, two binary, four binary, script binary").collect()  # 4 x languages
    langs = sorted({r["lang"] for r in rows})
    widths = {"two": 1 << 16, "four": 1 << BITS, "script": SCRIPT_COUNT}
    sums = {n: np.stack([sum(np.frombuffer(bytes(r[n]), np.float32).astype(float) for r in rows if r["lang"] == x) for x in langs]) if langs else np.zeros((0, w)) for n, w in widths.items()}

    def logs(counts: np.ndarray) -> np.ndarray:
        p = np.log((counts + ALPHA) / (counts.sum(1, keepdims=True) + ALPHA * counts.shape[1]))
        return np.ascontiguousarray((p - p.max(0)).T.astype(np.float32)) if len(p) else np.zeros((counts.shape[1], 0), np.float32)

    script = sums["script"]
    able = (script / np.maximum(script.sum(1, keepdims=True), 1) >= SHARE).T if langs else np.zeros((SCRIPT_COUNT, 0), bool)
    return LanguageModel(langs, logs(sums["two"]), logs(sums["four"]), able)


def label_documents(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: list[str] | None = None, spans: bool = False) -> DataFrame:
    """Columns ``keep`` of every row (all, if None) with ``lang_pred``, ``lang_score`` and, on request, ``lang_spans``.

    lang_pred is ``und`` where the text is null or has no letter; lang_score is the share of letters in spans of that
    language (0 for ``und``). Whole texts count. Repeated rows are labelled alike; an empty table gives an empty
    result; columns of docs of these names give way.
    """
    extra = "lang_pred string, lang_score double" + (", lang_spans array<struct<lang:string,first_word:int,words:int>>" if spans else "")
    return map_text(docs, text_col, list(docs.columns) if keep is None else keep, extra, lambda t: model.label(t, spans))
