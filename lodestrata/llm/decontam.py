"""Benchmark decontamination by latent semantic retrieval.

1. Words of all documents are hashed into BUCKETS terms and written, two bytes a word; documents are cut into
   passages of PASSAGE words. With A the TF-IDF passages, G the Gram matrix of their counts and D the idf
   diagonal, A^T A is D G D. A first pass adds up, by task, the terms' passage frequencies and G R for a
   random matrix R; as D is known then, the range of D G R is that of A^T A applied to random directions. A
   second pass applies A^T A to the basis Q of that range, a power iteration, and the small problem
   Q^T A^T A Q gives the leading right singular vectors V and their singular values S (RANK of them, without
   the LEADING first).
2. A window of words is folded in as S^-1 V^T D n, so that no direction outweighs another for being common.
   The fold has BUCKETS * RANK numbers and is shipped.
3. Windows of every document are folded, and those whose cosine to an item reaches COSINE are candidates.
   Windows step by STEP words and are at least STEP - 1 words longer than the item, so that one of them
   holds any copy whole. The latent space misses some paraphrases; a count of words does not: every window
   that holds PARAPHRASE of an item's words in any order is taken too, found by the item's rarest words (Bound).
4. A candidate is confirmed by the longest common subsequence of the window's and the item's words:
   COPY of the item's words in order, or PARAPHRASE of them and of its answer, the last ANSWER of
   the item. Cheaper, the words in common bound it from above first.

The benchmark is the stated query set: the space is made once, and items are searched BLOCK at a time.
"""

from __future__ import annotations

import copy
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.shared import bound_batches, forget, give_back, written

#: Shapes of passages and windows, in words.
PASSAGE, STEP, WINDOW = 48, 8, 24
#: Directions of the latent space, random ones more, and bits of a term's number.
RANK, OVERSAMPLE, BUCKET_BITS = 40, 8, 14
#: Leading directions left out: they tell what a text is in (its language, its kind), which every window of it shares.
LEADING = 8
BUCKETS = 1 << BUCKET_BITS
#: Singular values below this share of the largest are no directions.
LEAST_VALUE = 1e-4
#: Thresholds: cosine, and shares of the item's words in the longest common subsequence.
COSINE, COPY, PARAPHRASE = 0.8, 0.7, 0.5
#: The last share of an item that counts as its answer, and how much of it a paraphrase must hold.
ANSWER, ANSWER_SHARE = 0.25, 0.7
#: Items searched in one pass, and words of documents worked on at once.
BLOCK, WORDS_AT_ONCE = 500, 60_000
#: Cosines taken at once, and rows of a term summed at once.
COSINES_AT_ONCE, ROWS_AT_ONCE = 500_000, 8
#: Words of an item that Bound goes by, besides as many as a confirmed window may lack.
SURPLUS = 4
#: Hits of such words, and windows that hold enough of them, that are worked on at once.
HITS_AT_ONCE, WINDOWS_AT_ONCE = 300_000, 5_000
#: The number of a word that is no term, and bits of a term's slot.
OTHER, SLOT_BITS = -1, 18
#: In UTF-8, the bytes of words, where parted() has seen to other than ASCII characters: all but ASCII ones other than letters, digits and the underscore.
IS_WORD = np.array([n > 127 or chr(n).isalnum() or n == 95 for n in range(256)])
#: Random odd factors of a byte's value and of its place in a word, which make up the word's hash.
BYTE_VALUES = np.where(IS_WORD, np.random.default_rng(3).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1), np.uint64(0))
PLACE_VALUES = np.random.default_rng(4).integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
#: Terms that are summed together as one row of a shuffle, and tasks whose sums meet first.
TERMS_A_ROW, TASKS_A_SUM = 256, 64

_word = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _word.findall((text or "").lower())


def parted(texts: list[str | None]) -> list[str]:
    """The texts in lower case, with a space for each character over 127 that is in no word."""
    lower = [(t or "").lower() for t in texts]
    codes = np.frombuffer("".join([t for t in lower if not t.isascii()]).encode("utf-32-le"), "<u4")
    others = "".join([c for c in map(chr, np.unique(codes[codes > 127])) if not _word.match(c)])
    if not others:
        return lower
    spaces = str.maketrans(dict.fromkeys(others, " "))
    return [t if t.isascii() else t.translate(spaces) for t in lower]


def common_subsequence(a: list, b: list) -> int:
    """Length of the longest common subsequence, by the bits of a Python integer (one bit a word of a)."""
    masks: dict = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        if m := masks.get(w):
            both = row & m
            row = (row + both | row - both) & full
    return len(a) - row.bit_count()


class Spans:
    """Words of UTF-8 bytes as runs of word bytes: where they start, and a 64-bit hash of each."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        codes = np.frombuffer(data, np.uint8)
        inside = IS_WORD[codes]
        self.starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        if not len(self.starts):
            self.hashes = np.zeros(0, np.uint64)
            return
        tail = codes[self.starts[0] :]
        place = np.arange(len(tail)) - np.repeat(self.starts - self.starts[0], np.diff(np.concatenate([self.starts, [len(codes)]])))
        self.hashes = np.add.reduceat(BYTE_VALUES[tail] * PLACE_VALUES[place & 255], self.starts - self.starts[0])

    def words(self, first: int, last: int) -> list[str]:
        """The words from number first to before last, read by words_of()."""
        end = self.starts[last] if last < len(self.starts) else len(self.data)
        return words_of(self.data[self.starts[first] : end].decode())


class Terms:
    """The benchmark's items and their words, numbered; ships to the executors."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = [(i, w) for i, t in items if (w := words_of(t))]
        self.number({w for _, ws in self.items for w in ws})

    def number(self, chosen) -> None:
        self.of = {w: n for n, w in enumerate(sorted(chosen))}
        self.hash_of = np.array([Spans(w.encode()).hashes[:1].sum() for w in self.of] + [0], np.uint64)
        slots = (self.hash_of[:-1] >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.slots: list[np.ndarray] = []  # a term is in the first layer where its slot is free
        left = np.arange(len(slots))
        while len(left) or not self.slots:
            layer = np.full(1 << SLOT_BITS, OTHER, np.int32)
            layer[slots[left][::-1]] = left[::-1]
            self.slots.append(layer)
            left = left[layer[slots[left]] != left]

    def spans(self, texts: list[str | None]) -> tuple[np.ndarray, Spans]:
        """Words by text, and where the words of the texts lie, one after another.

        Here hashes stand for words, which is fast; words_of() has the last say.
        """
        coded = [t.encode() for t in parted(texts)]
        spans = Spans(b" ".join(coded))
        at = np.cumsum([len(t) + 1 for t in coded])
        return np.diff(np.searchsorted(spans.starts, np.concatenate([[0], at]))), spans

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, Spans]:
        """Numbers (OTHER: no word of an item) of all words of the texts, words by text, and where they lie."""
        lengths, spans = self.spans(texts)
        return self.found(spans.hashes), lengths, spans

    def found(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers of words by their hashes."""
        slots = (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        numbers = self.slots[0][slots]
        for more in self.slots[1:]:
            numbers = np.where((numbers >= 0) & (self.hash_of[numbers] == hashes), numbers, more[slots])
        numbers[self.hash_of[numbers] != hashes] = OTHER
        return numbers


def placed(numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the chunks that are terms: term number, text number and place in the text."""
    hit = np.flatnonzero(numbers >= 0)
    starts = np.cumsum(lengths) - lengths
    doc = np.searchsorted(starts + lengths, hit, "right")
    return numbers[hit].astype(np.int64), doc, hit - starts[doc] if len(hit) else hit


def random_directions(count: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((count, RANK + OVERSAMPLE)).astype("f4")


def batches(texts: list, a_word: int = 6):
    """Runs of texts of about WORDS_AT_ONCE words (of a_word characters or bytes each); a longer text is a run by itself."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "") // a_word
        if i > at and size + n > WORDS_AT_ONCE:
            yield at, texts[at:i]
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, texts[at:]


def terms_of(hashes: np.ndarray) -> np.ndarray:
    """Numbers of words in the latent space."""
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.uint16)


def filled(term: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """Terms of runs of size words, a row a run; the last run of a text is filled up with BUCKETS, which is no term."""
    count = -(-lengths // size)
    shift = (np.cumsum(count) * size - np.cumsum(lengths)) - (count * size - lengths)  # of each text's first word
    out = np.full(int(count.sum()) * size, BUCKETS, np.intp)
    out[np.arange(len(term)) + np.repeat(shift, lengths)] = term
    return out.reshape(-1, size)


def run_sums(rows: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Sums of the rows that each run names."""
    return np.einsum("ijk->ik", rows.take(runs.ravel(), 0).reshape(*runs.shape, rows.shape[1]))


def gram_times(term: np.ndarray, lengths: np.ndarray, directions: np.ndarray, into: np.ndarray, seen: np.ndarray) -> int:
    """Add the passages' share of G times directions to into, and of passage frequencies to seen; the number of passages.

    directions has a row of zeros at its end. Sums go by rows of a fixed number, which is the fast way.
    """
    runs = filled(term, lengths, PASSAGE)
    if not len(runs):
        return 0
    projected = np.concatenate([run_sums(directions, runs), np.zeros((1, directions.shape[1]), "f4")])
    flat = runs.ravel()
    real = np.flatnonzero(flat < BUCKETS)
    order = real[np.argsort(flat[real].astype(np.uint16), kind="stable")]
    ordered, passage = flat[order], order // PASSAGE
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    firsts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate([firsts, [len(ordered)]]))
    padded, parts = np.full(int((-(-sizes // ROWS_AT_ONCE)).sum()) * ROWS_AT_ONCE, len(runs), np.intp), -(-sizes // ROWS_AT_ONCE)
    begin = (np.cumsum(parts) - parts) * ROWS_AT_ONCE
    padded[np.arange(len(ordered)) + np.repeat(begin - firsts, sizes)] = passage
    into[ordered[firsts]] += np.add.reduceat(run_sums(projected, padded.reshape(-1, ROWS_AT_ONCE)), np.cumsum(parts) - parts, 0)
    new[1:] |= passage[1:] != passage[:-1]
    seen[ordered[firsts]] += np.add.reduceat(new, firsts, dtype=np.int64)
    return len(runs)


def written_terms(df: DataFrame, text: str) -> DataFrame:
    """t: the terms of every text's words, two bytes each."""
    splitter = Terms([])

    @F.pandas_udf("binary")
    def numbered(texts: pd.Series) -> pd.Series:
        out = []
        for _, some in batches(texts.tolist()):
            lengths, spans = splitter.spans(some)
            term, ends = terms_of(spans.hashes), np.cumsum(lengths)
            out += [term[a:b].tobytes() for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
        give_back()
        return pd.Series(out, dtype=object)

    return written(df.select(numbered(F.col(text).cast("string")).alias("t")), "terms")


def gram_pass(terms: DataFrame, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """G times directions, passage frequencies, and the number of passages of written_terms().

    Each task gives its sums in rows of TERMS_A_ROW terms; TASKS_A_SUM tasks' rows meet first, then theirs.
    """
    width = directions.shape[1]
    sent = terms.sparkSession.sparkContext.broadcast(np.concatenate([directions, np.zeros((1, width))]).astype("f4"))

    def add(frames):
        into, seen, passages = np.zeros((BUCKETS, width), "f4"), np.zeros(BUCKETS, np.int64), 0
        for f in frames:
            for _, some in batches(f["t"].tolist(), 2):
                passages += gram_times(np.frombuffer(b"".join(some), np.uint16), np.array([len(t) // 2 for t in some], np.int64), sent.value, into, seen)
        give_back()
        if passages:
            rows = [(k, seen[k : k + TERMS_A_ROW].astype("<i8").tobytes(), into[k : k + TERMS_A_ROW].astype("<f4").tobytes()) for k in range(0, BUCKETS, TERMS_A_ROW)]
            rows.append((-1, np.array([passages], "<i8").tobytes(), b""))
            yield pd.DataFrame(rows, columns=["k", "seen", "sums"])

    def total(part: pd.DataFrame) -> pd.DataFrame:
        seen = np.sum([np.frombuffer(x, "<i8") for x in part["seen"]], 0)
        sums = np.sum([np.frombuffer(x, "<f4").astype("f8") for x in part["sums"]], 0)
        return pd.DataFrame({"k": part["k"][:1], "seen": [seen.astype("<i8").tobytes()], "sums": [sums.astype("<f4").tobytes()]})

    schema = "k long, seen binary, sums binary"
    parts = terms.mapInPandas(add, schema).withColumn("some", F.floor(F.spark_partition_id() / TASKS_A_SUM))
    some = parts.groupBy("k", "some").applyInPandas(total, schema)
    summed = some.groupBy("k").applyInPandas(total, schema).collect()  # BUCKETS / TERMS_A_ROW rows and one
    gram, seen, passages = np.zeros((BUCKETS, width)), np.zeros(BUCKETS, np.int64), 0
    for r in summed:
        found = np.frombuffer(r.seen, "<i8")
        if r.k < 0:
            passages = int(found[0])
        else:
            seen[r.k : r.k + len(found)] = found
            gram[r.k : r.k + len(found)] = np.frombuffer(r.sums, "<f4").reshape(-1, width)
    sent.unpersist()
    return gram, seen, passages


def latent_space(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The fold (terms by directions, and a row of zeros) and the passage frequency of each term: a randomised SVD of all documents' passages."""
    terms = written_terms(df, text)
    gram, seen, passages = gram_pass(terms, np.random.default_rng(20).standard_normal((BUCKETS, RANK + OVERSAMPLE)))
    idf = np.log((passages + 1) / (seen + 1.0))
    basis = np.linalg.qr(idf[:, None] * gram)[0]
    small = basis.T @ (idf[:, None] * gram_pass(terms, idf[:, None] * basis)[0])
    forget(terms)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values)[LEADING:RANK]
    order = order[values[order] > max(values.max(initial=0) * LEAST_VALUE**2, 1e-9)]
    fold = idf[:, None] * (basis @ vectors[:, order]) / np.sqrt(values[order])
    fold = np.concatenate([fold, np.zeros((1, fold.shape[1]))]).astype("f4")
    del gram, basis, small
    give_back()
    return fold, seen


class Bound:
    """Words of each item of which a window must hold some to be confirmed; ships to the executors.

    A confirmed window holds PARAPHRASE of the item's words, so it lacks no more than the rest. Of any words
    of the item that are n more than the rest it holds n: the rarest are taken, SURPLUS more than the rest.
    """

    def __init__(self, terms: Terms, counts: dict[str, int], window: np.ndarray) -> None:
        self.window, self.least = window, np.zeros(len(terms.items), np.int64)
        items_of: dict[str, list[int]] = {}
        for i, (_, ws) in enumerate(terms.items):
            own, rest, taken = Counter(ws), len(ws) - math.ceil(PARAPHRASE * len(ws)), 0
            for w in sorted(own, key=lambda w: (counts.get(w, 0), -len(w), w)):
                if taken >= rest + SURPLUS:
                    break
                items_of.setdefault(w, []).append(i)
                taken += own[w]
            self.least[i] = taken - rest
        self.need = PARAPHRASE * np.array([len(ws) for _, ws in terms.items])
        self.every, self._bags = terms, None
        self.terms = copy.copy(terms)
        self.terms.number(items_of)
        self.items = np.array([i for w in self.terms.of for i in items_of[w]], np.int16)
        self.upto = np.cumsum([0, *[len(items_of[w]) for w in self.terms.of]])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_bags": None}

    @property
    def bags(self) -> np.ndarray:
        """How often each item (rows) holds each word (columns; the last is no word of any)."""
        if self._bags is None:
            self._bags = np.zeros((len(self.least), len(self.every.of) + 1), np.int16)
            np.add.at(self._bags, ([i for i, (_, ws) in enumerate(self.every.items) for _ in ws], [self.every.of[w] for _, ws in self.every.items for w in ws]), 1)
        return self._bags

    def candidates(self, hashes: np.ndarray, every: np.ndarray, lengths: np.ndarray):
        """(text number, first word, words, item number) of the windows that hold PARAPHRASE of an item's words in any order; every: the words' numbers."""
        starts = np.cumsum(lengths) - lengths
        term, doc, place = placed(self.terms.found(hashes), lengths)
        # items by turns, so that no more than about HITS_AT_ONCE hits are worked on at once
        seen = np.bincount(term, minlength=len(self.upto) - 1)
        turn = (np.cumsum(np.bincount(self.items, np.repeat(seen, np.diff(self.upto)), len(self.least))) // HITS_AT_ONCE)[self.items]
        for n in np.unique(turn):
            upto = np.concatenate([[0], np.cumsum(turn == n)])[self.upto]
            for doc_, at, size, item in self.windows(term, doc, place, lengths, upto, self.items[turn == n]):
                keep = self.held(every, starts[doc_] + at, np.minimum(size, lengths[doc_] - at), item) >= self.need[item]
                yield from zip(doc_[keep].tolist(), at[keep].tolist(), size[keep].tolist(), item[keep].tolist(), strict=True)

    def windows(self, term, doc, place, lengths, upto, items):
        """The windows that hold the least of the items' rarest words, as arrays of no more than WINDOWS_AT_ONCE."""
        some = upto[term + 1] - upto[term]
        item = items[np.arange(some.sum()) + np.repeat(upto[term] - np.cumsum(some) + some, some)]
        order = np.argsort(item, kind="stable")  # by item, then text and place
        item, doc, place = item[order].astype(np.int64), np.repeat(doc, some)[order], np.repeat(place, some)[order]
        to = np.arange(len(item)) + self.least[item] - 1
        first = np.flatnonzero(to < len(item))
        to = to[first]
        near = (item[to] == item[first]) & (doc[to] == doc[first]) & (place[to] - place[first] < self.window[item[first]])
        first, to = first[near], to[near]
        item, doc = item[first], doc[first]
        size = self.window[item]
        low = np.maximum(-((size - 1 - place[to]) // STEP), 0)  # windows that hold all places from first to to
        high = np.minimum(place[first] // STEP, np.maximum(-(-lengths[doc] // STEP) - size // STEP, 0))
        # of windows that overlap those of the hit before only the new ones
        low[1:] = np.where((item[1:] == item[:-1]) & (doc[1:] == doc[:-1]), np.maximum(low[1:], high[:-1] + 1), low[1:])
        some = np.maximum(high - low + 1, 0)
        ends = np.cumsum(some)
        for n in range(0, int(ends[-1]) if len(ends) else 0, WINDOWS_AT_ONCE):
            k = np.arange(n, min(n + WINDOWS_AT_ONCE, ends[-1]))
            of = np.searchsorted(ends, k, "right")
            yield doc[of], (low[of] + k - ends[of] + some[of]) * STEP, size[of], item[of]

    def held(self, every: np.ndarray, start: np.ndarray, size: np.ndarray, item: np.ndarray) -> np.ndarray:
        """How many of the item's words each window holds."""
        place = np.arange(size.max(initial=0))
        words = every[np.minimum(start[:, None] + place, len(every) - 1)]
        words[place >= size[:, None]] = OTHER
        row, at = np.nonzero(self.bags[item[:, None], words])
        key, count = np.unique(row * len(self.every.of) + words[row, at], return_counts=True)
        row, word = np.divmod(key, len(self.every.of))
        return np.bincount(row, np.minimum(count, self.bags[item[row], word]), len(item))


class Search:
    """Items folded into the latent space, by the window that fits them; ships to the executors."""

    def __init__(self, terms: Terms, fold: np.ndarray, seen: np.ndarray) -> None:
        self.terms, self.fold = terms, fold
        sizes = np.array([len(ws) for _, ws in terms.items], np.int64)
        self.fit = STEP * -(-(sizes + STEP - 1) // STEP)
        number = dict(zip(terms.of, terms_of(terms.hash_of[:-1]).tolist(), strict=True))
        self.bound = Bound(terms, {w: int(seen[n]) for w, n in number.items()}, WINDOW * -(-(sizes + STEP - 1) // WINDOW))
        latent = np.array([fold[[number[w] for w in ws]].sum(0) for _, ws in terms.items]).reshape(len(sizes), -1)
        self.latent = (latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)).astype("f4")
        self.bags = [Counter(ws) for _, ws in terms.items]

    def candidates(self, term: np.ndarray, every: np.ndarray, lengths: np.ndarray):
        """(text number, first word, words, item number) of the windows that are near an item; every: the words' numbers.

        A window with fewer of the item's words than any check confirms goes no further.
        """
        blocks = -(-lengths // STEP)  # of each text
        total = int(blocks.sum())
        if not total or not self.latent.shape[1]:
            return
        first = np.cumsum(blocks) - blocks
        of_block = np.repeat(np.arange(len(lengths)), blocks)
        at = np.arange(total)
        folded = np.zeros((total + 1, self.fold.shape[1]), "f8")
        np.cumsum(run_sums(self.fold, filled(term, lengths, STEP)), 0, dtype="f8", out=folded[1:])
        last = first[of_block] + blocks[of_block]  # the block after the text's last
        has, starts = (self.bound.bags > 0).view(np.uint8), np.cumsum(lengths) - lengths
        for size in np.unique(self.fit):
            mine = np.flatnonzero(self.fit == size)
            end = np.minimum(at + size // STEP, last)
            # a window that runs over the end says no more than the last whole one
            some = np.flatnonzero((at + size // STEP <= last) | (at == first[of_block]))
            for n in range(0, len(some), max(1, COSINES_AT_ONCE // len(mine))):
                w = some[n : n + max(1, COSINES_AT_ONCE // len(mine))]
                window = (folded[end[w]] - folded[w]).astype("f4")
                norm = np.linalg.norm(window, axis=1)
                k, i = np.nonzero(window @ self.latent[mine].T >= (COSINE * np.where(norm > 0, norm, np.inf))[:, None])
                if not len(k):
                    continue
                new = np.concatenate([[True], k[1:] != k[:-1]])
                b = w[k[new]]  # each window once, its words are looked up for all its items
                doc, place = of_block[b], (b - first[of_block[b]]) * STEP
                words = (starts[doc] + place)[:, None] + np.arange(size)
                words = np.where(words < (starts + lengths)[doc][:, None], every.take(words, mode="clip"), len(self.terms.of)).astype(np.int32)
                words[words < 0] = len(self.terms.of)
                row = np.cumsum(new) - 1
                for m in range(0, len(k), WINDOWS_AT_ONCE):
                    of, item = row[m : m + WINDOWS_AT_ONCE], mine[i[m : m + WINDOWS_AT_ONCE]]
                    flat = words.take(of, 0)
                    flat += (item * has.shape[1]).astype(np.int32)[:, None]
                    keep = has.ravel().take(flat).sum(1, dtype=np.uint16) >= self.bound.need[item]
                    of, item = of[keep], item[keep]
                    yield from zip(doc[of].tolist(), place[of].tolist(), [int(size)] * len(of), item.tolist(), strict=True)

    def confirmed(self, window: list[str], item: int) -> float:
        """Share of the item's words in the longest common subsequence, or 0 if that does not confirm it."""
        own = self.terms.items[item][1]
        bag = dict(self.bags[item])
        common = 0
        for w in window:
            if n := bag.get(w):
                bag[w], common = n - 1, common + 1
        if common < PARAPHRASE * len(own):
            return 0.0
        share = common_subsequence(own, window) / len(own)
        if share >= COPY:
            return share
        answer = own[-max(1, round(ANSWER * len(own))) :]
        return share if share >= PARAPHRASE and common_subsequence(answer, window) >= ANSWER_SHARE * len(answer) else 0.0

    def leaks(self, texts: list[str | None]) -> list[list[tuple[int, float]]]:
        """For each text the items it holds (item id, share), each with its best window."""
        out: list[dict[int, float]] = [{} for _ in texts]
        for start, some in batches(texts):
            lengths, spans = self.terms.spans(some)
            starts = np.cumsum(lengths) - lengths
            every = self.terms.found(spans.hashes)
            near = dict.fromkeys([*self.candidates(terms_of(spans.hashes), every, lengths), *self.bound.candidates(spans.hashes, every, lengths)])
            for doc, at, size, item in near:
                found, item_id = out[start + doc], self.terms.items[item][0]
                if found.get(item_id, 0) < 1.0:
                    window = spans.words(starts[doc] + at, starts[doc] + min(at + size, lengths[doc]))
                    if share := self.confirmed(window, item):
                        found[item_id] = max(share, found.get(item_id, 0.0))
        return [sorted(found.items()) for found in out]


def blocks_of(benchmark: DataFrame, item_id: str, text: str):
    """The benchmark's items, BLOCK at a time."""
    rows = benchmark.select(F.col(item_id).cast("long"), F.col(text).cast("string")).where(f"`{item_id}` IS NOT NULL AND length(`{text}`) > 0").distinct().orderBy(item_id, text).toLocalIterator()
    block: list[tuple[int, str]] = []
    for r in rows:
        block.append((r[0], r[1]))
        if len(block) == BLOCK:
            yield block
            block = []
    if block:
        yield block


#: The type of a text's leaks.
LEAKS = "array<struct<item_id: long, share: double>>"


def searched(sent):
    """A function of texts that gives their leaks, by the Search in the broadcast variable sent."""

    @F.pandas_udf(LEAKS)
    def leaks(texts: pd.Series) -> pd.Series:
        found = sent.value.leaks(texts.tolist())
        give_back()
        return pd.Series([[{"item_id": i, "share": s} for i, s in own] for own in found], dtype=object)

    return leaks


def find_leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """df with leaks, an array of (item_id, share): the benchmark items each text holds, by item_id.

    share is that of the item's words found in order (the longest common subsequence). A null, empty
    or wordless text, or an empty benchmark, gives an empty array; items without id or words are
    left out; items that repeat are one. An item id with several texts counts for each of them.
    Rows repeat as they are, extra columns stay, a column named leaks is replaced. A very long text is
    searched whole, with memory in proportion to it; an empty table gives an empty result.
    """
    spark = df.sparkSession
    bound_batches(spark)
    out = df.withColumn("leaks", F.array().cast(LEAKS))
    space = None
    for block in blocks_of(benchmark, item_id, item_text):
        terms = Terms(block)
        if not terms.items:
            continue
        if space is None:
            space = latent_space(df, text)
        sent = spark.sparkContext.broadcast(Search(terms, *space))

        out = out.withColumn("leaks", F.concat("leaks", searched(sent)(F.col(text).cast("string"))))
    return out


def contaminated(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document and leaked item: doc_id, item_id and share, the longest of repeated hits."""
    found = find_leaks(df.select("doc_id", "text"), benchmark)
    # an outer explode asks nothing of the array beforehand, which would search every text twice
    return found.select("doc_id", F.explode_outer("leaks").alias("leak")).where("leak IS NOT NULL").select("doc_id", "leak.item_id", "leak.share")

