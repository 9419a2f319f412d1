"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features, and those of the lines before and after it, weigh for
either label; a transition weight ties neighbours. Forward-backward gives each line's marginal of
being good, and a document's quality is their mean weighted by line length, put on a scale by a
logistic step. Lines take their document's label in training, by gradient ascent on the exact
likelihood of a bounded sample: TRAIN_DOCS labelled documents of TRAIN_BYTES together, of which each gives
chains of up to TRAIN_LINES lines. Scoring takes every line of every document.

Forward-backward goes by blocks of BLOCK lines: the product of a block's steps carries what comes into it to
its end, so that all blocks are worked on side by side, a line of each a step, and a text of very many lines
takes no more steps than a short one but for one a block. A worker holds features of BYTES_AT_ONCE of text at
a time, and of the rest two numbers a line.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.shared import bound_batches, give_back, held_out

#: Bounds of the training sample (documents, their bytes together and each), lines of a chain, steps and rate of the ascent, and the penalty on large weights.
TRAIN_DOCS, TRAIN_BYTES, TRAIN_TEXT, TRAIN_LINES, STEPS, RATE, PENALTY = 3_000, 16_000_000, 1_000_000, 64, 150, 0.15, 1e-3
#: Score from which a document is predicted good, bytes of text and lines worked on at once, and lines of a block.
GOOD, BYTES_AT_ONCE, LINES_AT_ONCE, BLOCK = 0.3, 500_000, 65_536, 256
#: How fast a score rises with the share of good lines; where it crosses GOOD is fitted.
SLOPE = 8.0
#: Features of one line; a chain position has them three times, and a constant.
LINE_FEATURES = 13

LETTER, UPPER, DIGIT, SPACE, MARK, STOP, OTHER = range(7)
#: The class of each byte: those over 127 belong to letters.
CLASSES = np.array([LETTER if n > 127 or chr(n).islower() else UPPER if chr(n).isupper() else DIGIT if chr(n).isdigit() else SPACE if chr(n).isspace() else STOP if chr(n) in ".,;:?'\"()-" else MARK for n in range(256)], np.uint8)


def line_features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of the lines of data, each ended by a line end, and the lines' lengths in bytes."""
    codes = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(codes == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = (ends - starts).astype("i4")
    kinds = CLASSES[codes]
    n = np.maximum(length, 1).astype("f4")

    def count(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, starts, dtype=np.int32)

    blank = kinds == SPACE
    before = np.concatenate([[True], blank[:-1]])
    begin = np.flatnonzero(~blank & before)
    end = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]]))
    word_start = np.zeros(len(codes), bool)
    word_start[begin] = True
    words = np.maximum(count(word_start) + 1, 1)
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (kinds[1:] == MARK)
    # a word like the one before it in the line: equal in length and in its first and last bytes
    sign = (end - begin) << 24 | codes[begin].astype("i8") << 16 | codes[np.minimum(begin + 1, len(codes) - 1)].astype("i8") << 8 | codes[end]
    line = np.searchsorted(ends, begin)
    again = np.zeros(len(codes), bool)
    again[begin[1:][(sign[1:] == sign[:-1]) & (line[1:] == line[:-1])]] = True
    out = np.zeros((len(ends), LINE_FEATURES), "f4")
    out[:, 0] = np.log1p(length) / 8
    out[:, 1] = count(kinds == UPPER) / n
    out[:, 2] = count(kinds == DIGIT) / n
    out[:, 3] = np.minimum(1, 4 * count(kinds == MARK) / n)
    out[:, 4] = count(kinds == STOP) / n * 4
    out[:, 5] = count(same) / n * 4
    out[:, 6] = np.minimum(1, count(codes == 124) / words)  # bars, of menus
    out[:, 7] = np.minimum(1, count(codes == 33) / words)
    out[:, 8] = np.minimum(n / words / 12, 2)
    out[:, 9] = np.minimum(words, 40) / 40
    out[:, 10] = length == 0
    out[:, 11] = np.isin(codes[np.maximum(ends - 1, 0)], np.frombuffer(b".?!", np.uint8)) & (length > 0)
    out[:, 12] = np.minimum(1, 2 * count(again) / words)
    return out, length


def pieces(data: bytes):
    """Runs of whole lines of about BYTES_AT_ONCE bytes and LINES_AT_ONCE lines; a longer line is a run by itself."""
    at = 0
    while at < len(data):
        cut = data.rfind(b"\n", at, at + BYTES_AT_ONCE) + 1 or data.find(b"\n", at) + 1
        if (many := np.flatnonzero(np.frombuffer(data, np.uint8, cut - at, at) == 10)[LINES_AT_ONCE - 1 : LINES_AT_ONCE]).size:
            cut = at + int(many[0]) + 1
        yield data[at:cut]
        at = cut


def joined_lines(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """The lines of all texts, each ended by a line end, and their number by text, one at least."""
    coded = [(t or "").encode() for t in texts]
    return b"".join([c + b"\n" for c in coded]), np.array([c.count(b"\n") + 1 for c in coded], np.int64)


def chain_features(own: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Each line's features with those of its neighbours in the same text (zero where there is none) and a constant."""
    last = np.cumsum(lines) - 1
    first = last - lines + 1
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[last] = 0, 0
    return np.concatenate([own, before, after, np.ones((len(own), 1), own.dtype)], 1)


class Blocks:
    """Chains of lines cut into blocks, which are worked on side by side."""

    def __init__(self, lines: np.ndarray) -> None:
        self.lines, self.first = lines, np.cumsum(lines) - lines
        self.count = -(-lines // BLOCK)  # of each chain
        self.before = np.cumsum(self.count) - self.count  # blocks of chains before
        chain = np.repeat(np.arange(len(lines)), self.count)
        self.rank = np.arange(len(chain)) - self.before[chain]
        self.start = self.first[chain] + self.rank * BLOCK
        self.size = np.minimum(BLOCK, lines[chain] - self.rank * BLOCK)

    def runs(self, of: np.ndarray):
        """These blocks, of about LINES_AT_ONCE lines together, by falling length: their numbers, and how many have a t-th line."""
        ends = np.cumsum(self.size[of])
        at = 0
        while at < len(ends):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LINES_AT_ONCE, "right"))
            some = of[at : max(to, at + 1)]
            some = some[np.argsort(-self.size[some], kind="stable")]
            yield some, np.searchsorted(-self.size[some], -np.arange(self.size[some[0]]), side="left")
            at = max(to, at + 1)

    def steps(self, what: np.ndarray):
        """The blocks of rank 1, 2 and so on of all chains that have them, first to last."""
        for k in range(1, int(what.max(initial=0))):
            yield self.before[what > k] + k


def emissions(good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights of bad and good for lines with these log weights of good over bad, and the log by which they are scaled down."""
    shift = np.maximum(good, 0)
    return np.stack([np.exp(-shift), np.exp(good - shift)], 1), shift


def marginals(good: np.ndarray, transition: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginal of good for each line, the sum of pair marginals (2 by 2), and log partition by text.

    good: log weight of good over bad for each line. transition: log weights, from (row) to (column).
    """
    weight, blocks = np.exp(transition), Blocks(lines)
    # what each block makes of what comes into it; a chain's first line has nothing before it
    through = np.zeros((len(blocks.start), 2, 2))
    for some, active in blocks.runs(np.flatnonzero(np.repeat(blocks.count > 1, blocks.count))):
        product = np.repeat(np.eye(2)[None], len(some), 0)
        for t, n in enumerate(active.tolist()):
            emit = emissions(good[blocks.start[some[:n]] + t])[0][:, None]
            step = product[:n] @ weight
            if t == 0:
                step[blocks.rank[some] == 0] = np.eye(2)
            step = step * emit
            product[:n] = step / step.sum((1, 2), keepdims=True)
        through[some] = product
    into = np.full((len(blocks.start), 2), 0.5)
    for at in blocks.steps(blocks.count):
        v = np.einsum("ni,nij->nj", into[at - 1], through[at - 1])
        into[at] = v / v.sum(1, keepdims=True)
    back = np.ones((len(blocks.start), 2))
    for at in list(blocks.steps(blocks.count))[::-1]:
        v = np.einsum("nij,nj->ni", through[at], back[at])
        back[at - 1] = v / v.sum(1, keepdims=True)
    p, log_z, pairs = np.zeros(len(good), "f4"), np.zeros(len(lines)), np.zeros((2, 2))
    chain = np.repeat(np.arange(len(lines)), blocks.count)
    for some, active in blocks.runs(np.arange(len(blocks.start))):
        place = np.cumsum(blocks.size[some]) - blocks.size[some]
        total = int(blocks.size[some].sum())
        forward, backward, scale = np.zeros((total, 2)), np.ones((total, 2)), np.ones(total)
        line = np.repeat(blocks.start[some] - place, blocks.size[some]) + np.arange(total)
        emit, shift = emissions(good[line])
        for t, n in enumerate(active.tolist()):
            at = place[:n] + t
            a = (into[some] if t == 0 else forward[at - 1]) @ weight
            if t == 0:
                a[blocks.rank[some] == 0] = 1.0
            a = a * emit[at]
            scale[at] = a.sum(1)
            forward[at] = a / scale[at][:, None]
        last = place + blocks.size[some] - 1
        backward[last] = back[some] / (forward[last] * back[some]).sum(1, keepdims=True)
        for t in range(len(active) - 1, 0, -1):
            at = place[: active[t]] + t
            backward[at - 1] = (emit[at] * backward[at] / scale[at][:, None]) @ weight.T
        after = emit * backward / scale[:, None]
        inner = np.ones(total, bool)
        inner[place] = False
        inner = np.flatnonzero(inner)
        pairs += weight * (forward[inner - 1].T @ after[inner])
        joint = np.flatnonzero(blocks.rank[some] > 0)  # pairs over the seam of two blocks
        pairs += weight * (into[some[joint]].T @ after[place[joint]])
        both = forward * backward
        p[line] = both[:, 1] / both.sum(1)
        np.add.at(log_z, np.repeat(chain[some], blocks.size[some]), np.log(scale) + shift)
    return p, pairs, log_z


class LineModel:
    """Weights of the field and of the logistic step from weighted marginals to a score."""

    def __init__(self) -> None:
        self.weights, self.transition = np.zeros(3 * LINE_FEATURES + 1), np.zeros((2, 2))
        self.slope, self.offset = 1.0, 0.0

    def fit(self, texts: list[str | None], labels: list[int]) -> LineModel:
        """Fit to whole-text labels (0 or 1); without texts of both labels every score is near 1, near 0, or 0.5 without any."""
        y = np.array(labels, float)
        if len(set(labels)) < 2:
            self.slope, self.offset = 0.0, (4.0 if labels and labels[0] == 1 else 0.0 if not labels else -4.0)
            return self
        data, lines = joined_lines(texts)
        found = [line_features(piece) for piece in pieces(data)]
        own, length = (np.concatenate(part) for part in zip(*found, strict=True))
        x = chain_features(own, lines)
        text = np.repeat(np.arange(len(lines)), lines)
        place = np.arange(len(text)) - np.repeat(np.cumsum(lines) - lines, lines)
        chain = np.unique(text * (1 << 32) + place // TRAIN_LINES, return_counts=True)[1]  # long texts as several chains
        target = y[text]
        # both labels weigh alike, and a text no more for having many lines
        weight = (1 / np.sqrt(lines))[text] * np.where(target == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        weight /= weight.mean()
        ties, pull = np.zeros((2, 2)), 0.1  # neighbours of a text always agree here, which says less than the lines do
        inner = np.flatnonzero(text[1:] == text[:-1])
        inner = inner[place[inner + 1] % TRAIN_LINES != 0]
        np.add.at(ties, (target[inner].astype(int), target[inner + 1].astype(int)), 1.0)
        params = np.concatenate([self.weights, self.transition.ravel()])
        mean, second = np.zeros_like(params), np.zeros_like(params)
        for step in range(1, STEPS + 1):
            w, tr = params[: x.shape[1]], params[x.shape[1] :].reshape(2, 2)
            p, pairs, _ = marginals(x @ w, tr, chain)
            gradient = np.concatenate([x.T @ (weight * (target - p)), pull * (ties - pairs).ravel()]) / len(x) - PENALTY * params
            mean, second = 0.9 * mean + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
            params = params + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            params[x.shape[1] :] = np.clip(params[x.shape[1] :], -3, 3)
        self.weights, self.transition = params[: x.shape[1]], params[x.shape[1] :].reshape(2, 2)
        self.slope, self.offset = logistic(self.raw(texts), y)
        return self

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted mean of the lines' marginals of being good, by text; empty lines weigh a little."""
        data, lines = joined_lines(texts)
        total, at = int(lines.sum()), 0
        weights = self.weights[:-1].reshape(3, LINE_FEATURES).T
        good, length = np.full(total, self.weights[-1], "f4"), np.zeros(total, "i4")
        last = np.zeros(total, bool)
        last[np.cumsum(lines) - 1] = True
        for piece in pieces(data):
            own, some = line_features(piece)
            share = own @ weights  # of the line itself, for the one after it, for the one before it
            to = at + len(some)
            good[at:to] += share[:, 0]
            length[at:to] = some
            end = min(to + 1, total)
            good[at + 1 : end] += np.where(last[at : end - 1], 0, share[: end - 1 - at, 1])
            begin = max(at - 1, 0)
            good[begin : to - 1] += np.where(last[begin : to - 1], 0, share[begin + 1 - at :, 2])
            at = to
        p, _, _ = marginals(good, self.transition, lines)
        first, weight = np.cumsum(lines) - lines, length + np.float32(0.01)
        return np.add.reduceat(p * weight, first, dtype="f8") / np.add.reduceat(weight, first, dtype="f8")

    def score(self, texts: list[str | None]) -> np.ndarray:
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= BYTES_AT_ONCE):
                size += len(texts[end] or "")
                end += 1
            out[at:end] = 1 / (1 + np.exp(-(self.slope * self.raw(texts[at:end]) + self.offset)))
            at = end
        return out


def logistic(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """SLOPE, and the offset by which GOOD is where label 1 becomes the better guess, a good text lost counting twice a bad one kept."""
    weight = np.where(y == 1, 2 * 0.5 / y.mean(), 0.5 / (1 - y.mean()))  # a good text lost counts twice
    cuts = np.unique(np.quantile(raw, np.linspace(0, 1, 201)))
    right = [(weight * ((raw >= c) == (y == 1))).sum() for c in cuts]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-9)
    cut = float(cuts[best].mean())
    below = raw[raw < cut].max(initial=0.0)
    cut = (cut + below) / 2
    return SLOPE, float(np.log(GOOD / (1 - GOOD)) - SLOPE * cut)


def train(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> LineModel:
    """Model of labelled documents that are not held out: the TRAIN_DOCS rows with the least hash of their id, as far as TRAIN_BYTES go.

    Rows with a null id, label or text, or a text over TRAIN_TEXT bytes, teach nothing; an id with several labels
    or texts counts for each pair, within the bounds.
    """
    marked = labels.where(~held_out(doc_id) & F.col(label).isin(0, 1)).select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label"))
    some = marked.orderBy(F.xxhash64("id"), "id", "label").limit(TRAIN_DOCS)
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).where(F.octet_length("text") <= TRAIN_TEXT).join(F.broadcast(some), "id")
    order = [F.xxhash64("id"), F.col("id"), F.col("label"), F.col("text")]
    rows = rows.orderBy(*order).limit(TRAIN_DOCS).withColumn("upto", F.sum(F.octet_length("text").cast("long")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))  # of TRAIN_DOCS rows
    rows = rows.where(F.col("upto") <= TRAIN_BYTES).drop("upto").collect()
    rows = sorted(rows, key=lambda r: (r.id, r.label, r.text))
    return LineModel().fit([r.text for r in rows], [r.label for r in rows])


def rate(df: DataFrame, model: LineModel, text: str = "text") -> DataFrame:
    """df with score (0 to 1) and predicted (1 if score >= GOOD, else 0), of whole texts; row by row, no shuffle.

    A null text is scored like an empty one, which is one empty line. Repeated rows score alike, and no
    text's score depends on others. Of a very long text a worker holds features of a part at a time. An
    empty table gives an empty result. Columns of df named like a result are replaced.
    """
    bound_batches(df.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        out = pd.Series(model.score(texts.tolist()))
        give_back()
        return out

    got = df.withColumn("score", scored(F.col(text).cast("string")))
    return got.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def ratings(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    model = train(df, labels)
    return rate(df.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
