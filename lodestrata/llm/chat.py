"""Chat formatting: roles of transcript lines by a hidden Markov model, rendered as canonical turns.

A transcript is rows of lines in order. Each line gives observations: the speaker marker it starts
with (if any), whether it opens the transcript, ends in a question mark, and its length class. The
hidden state is the role and whether the line starts a turn or goes on with it; Viterbi finds the
best sequence, and the lines of a turn then stand under one header.

How often roles open a transcript and follow each other, how many lines a turn has, how long lines are and
how often they ask is estimated from labelled turns (fit()); how markers stand for roles is set by hand.

A transcript may be very long. Rows are dealt by (transcript, block of lines): each block is reduced
to a matrix of best scores from its first to its last state, a short chain of those matrices per
transcript fixes the states at the block borders, and each block is then decoded between them. This
is exact. Many blocks pass a task one after another, sorted, so that it holds one batch and one block.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.shared import bound_batches, held_out, written

#: Lines of a block, about, and blocks of a transcript chained at once.
BLOCK, CHAIN = 256, 4_096
#: Labelled turns that a model is fitted to, at most.
TRAIN_TURNS = 20_000
#: Roles, and the words that mark them.
ROLES = ("system", "user", "assistant")
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "question", "q", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "model", "agent"),
}
_marker = re.compile(r"^\s*(?:[#>*\-]+\s*|<\|?(?:im_start\|>)?\s*|\[)?\s*(" + "|".join(sorted((w for ws in MARKERS.values() for w in ws), key=len, reverse=True)) + r")\s*(?:\*\*)?\s*(?:\|?>|\]|:|-{1,2}(?=\s)|\n|$)(?:\*\*)?[ \t]*", re.IGNORECASE)
_role_of = {w: role for role, ws in MARKERS.items() for w in ws}

#: States are role * 2 + (1 where the line goes on with a turn).
STATES = 2 * len(ROLES)
#: The row of a block's matrix, after those of the states before it, that holds where it opens the transcript.
OPENING = STATES
#: Probabilities of markers, by hand: a turn's first line has its role's, a further line has any, a first line has another's.
P_MARKER_START, P_MARKER_GOES_ON, P_WRONG_MARKER = 0.7, 0.01, 0.01
#: Characters from which a line is of middle length, and long.
SHORT, LONG = 120, 400


@dataclass(frozen=True)
class Model:
    """Probabilities by role: of opening a transcript, of the next turn's role, of short, middle and long first lines, of questions; and of a line going on."""

    start: tuple[float, ...] = (0.25, 0.6, 0.15)
    following: tuple[tuple[float, ...], ...] = ((0.02, 0.9, 0.08), (0.01, 0.09, 0.9), (0.01, 0.92, 0.07))
    lengths: tuple[tuple[float, ...], ...] = ((0.4, 0.4, 0.2), (0.4, 0.4, 0.2), (0.2, 0.4, 0.4))
    question: tuple[float, ...] = (0.05, 0.4, 0.1)
    goes_on: float = 0.35

    def step(self) -> np.ndarray:
        """Log probability from state (row) to state (column)."""
        out = np.full((STATES, STATES), -np.inf)
        for r in range(len(ROLES)):
            for s in (2 * r, 2 * r + 1):
                out[s, 2 * r + 1] = np.log(self.goes_on)
                for k in range(len(ROLES)):
                    out[s, 2 * k] = np.log((1 - self.goes_on) * self.following[r][k])
        return out


#: What is taken where nothing is labelled.
BY_HAND = Model()


def fit(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Model:
    """A model by the counts of labelled turns, each one higher, of transcripts that are not held out.

    TRAIN_TURNS turns are taken, those with the least hash, with the turn after each; turn 0 opens a transcript.
    Turns of other roles, and null ids or numbers, teach nothing; a table without any gives the model by hand.
    """
    rows = conversations.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = rows.where(~held_out("conv") & F.col("turn").isNotNull() & F.col("role").isin(*ROLES))
    some = rows.orderBy(F.xxhash64("conv", "turn"), "conv", "turn", "text").limit(TRAIN_TURNS)
    lines = F.split("text", "\n")
    first = lines[0]
    size = F.when(F.length(first) < SHORT, 0).when(F.length(first) < LONG, 1).otherwise(2)
    some = written(some.select("conv", "turn", "role", size.alias("size"), F.rtrim(first).endswith("?").alias("asks"), (F.size(lines) - 1).alias("more")), "chat-sample")
    following = rows.select("conv", (F.col("turn") - 1).alias("turn"), F.col("role").alias("next")).join(F.broadcast(some.select("conv", "turn", "role")), ["conv", "turn"])
    seen = some.groupBy("role", "size", "asks").agg(F.count("*").alias("n"), F.sum("more").alias("more"), F.sum((F.col("turn") == 0).cast("int")).alias("opens")).collect()  # 18 rows at most
    steps = following.groupBy("role", "next").count().collect()  # 9
    if not seen:
        return BY_HAND
    opens, asks, goes, sizes, nexts = np.ones(3), np.ones((3, 2)), np.ones(2), np.ones((3, 3)), np.ones((3, 3))
    for r in seen:
        i = ROLES.index(r.role)
        opens[i] += r.opens
        asks[i, int(r.asks)] += r.n
        sizes[i, r.size] += r.n
        goes += (r.n, r.more)
    for r in steps:
        nexts[ROLES.index(r.role), ROLES.index(r.next)] += r["count"]
    shares = lambda x: tuple(map(tuple, x / x.sum(1, keepdims=True)))
    return Model(tuple(opens / opens.sum()), shares(nexts), shares(sizes), tuple(asks[:, 1] / asks.sum(1)), float(goes[1] / goes.sum()))


def marker_of(line: str) -> tuple[str | None, str]:
    """The role that a line's marker names, if it has one, and the line without the marker."""
    if found := _marker.match(line):
        return _role_of[found[1].lower()], line[found.end() :]
    return None, line


def emission(lines: list[str | None], first: bool, model: Model = BY_HAND) -> np.ndarray:
    """Log probability of each line (rows) under each state; first: whether the first line opens the transcript."""
    kinds = np.zeros(len(lines), np.int64)
    for i, line in enumerate(lines):
        marked, rest = marker_of(line or "")
        size = 0 if len(rest) < SHORT else 1 if len(rest) < LONG else 2
        kinds[i] = (0 if marked is None else 1 + ROLES.index(marked)) * 6 + size * 2 + rest.rstrip().endswith("?")
    out = observed(model)[kinds]
    if first and len(lines):
        out[0, 1::2] = -np.inf
        out[0, 0::2] += np.log(model.start)
    return out


def observed(model: Model) -> np.ndarray:
    """Log probability of each kind of line (marker or none, by length, by question) under each state."""
    out = np.zeros((24, STATES))
    for kind in range(24):
        marked, size, asks = kind // 6, kind // 2 % 3, kind % 2
        for r in range(len(ROLES)):
            seen = np.log((1 - P_MARKER_START) if not marked else P_MARKER_START if marked == r + 1 else P_WRONG_MARKER)
            on = np.log((1 - P_MARKER_GOES_ON) if not marked else P_MARKER_GOES_ON / len(ROLES))
            shared = np.log(model.question[r] if asks else 1 - model.question[r])
            out[kind, 2 * r] = seen + shared + np.log(model.lengths[r][size])
            out[kind, 2 * r + 1] = on + shared + np.log(1 / 3)
    return out


def best_matrix(scores: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Best log probability of a block from the state before it (row) to its last state (column).

    For a block that opens a transcript every row is the same, as nothing is before it.
    """
    opens = np.isneginf(scores[0, 1::2]).all()
    now = np.repeat(scores[:1], STATES, 0) if opens else step + scores[0]
    for e in scores[1:]:
        now = (now[:, :, None] + step[None]).max(1) + e
    return now


def decode(scores: np.ndarray, step: np.ndarray, before: int | None, last: int) -> np.ndarray:
    """Best states of a block, given the state before it and its last state; ties go to the lower state."""
    best = scores[0] + (step[before] if before is not None else 0)
    back = np.zeros((len(scores), STATES), np.int8)
    for t in range(1, len(scores)):
        ways = best[:, None] + step
        back[t] = ways.argmax(0)
        best = ways.max(0) + scores[t]
    out = np.zeros(len(scores), np.int8)
    out[-1] = last
    for t in range(len(scores) - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The matrix of several blocks in a row."""
    now = matrices[0]
    for m in matrices[1:]:
        now = (now[:, :, None] + m[None]).max(1)
    return now


def borders(matrices: list[np.ndarray], before: int = -1, last: int | None = None) -> list[int]:
    """Last state of each block in a row, given the state before them (-1: the first opens) and, if known, the last state."""
    best, back = matrices[0][OPENING if before < 0 else before], []
    for m in matrices[1:]:
        ways = best[:, None] + m[:STATES]
        back.append(ways.argmax(0))
        best = ways.max(0)
    out = [int(best.argmax()) if last is None else last]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def square(flat) -> np.ndarray:
    return np.array(flat).reshape(-1, STATES)


MATRIX, BORDERS = "conv string, block long, matrix array<double>", "conv string, block long, before int, last int"


def chained(blocks: DataFrame) -> DataFrame:
    """State before (-1: none) and last state of every block, by runs of CHAIN blocks, runs of runs and so on."""
    most = blocks.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    if most <= CHAIN:

        def whole(key, frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("block")
            found = borders([square(m) for m in frame["matrix"]])
            return pd.DataFrame({"conv": frame["conv"], "block": frame["block"], "before": [-1, *found[:-1]], "last": found})

        return blocks.groupBy("conv").applyInPandas(whole, BORDERS)

    def run_of(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("block")
        first, *rest = [square(m) for m in frame["matrix"]]
        m = product([first, *[m[:STATES] for m in rest]])
        return pd.DataFrame({"conv": frame["conv"][:1], "block": frame["run"][:1], "matrix": [m.ravel().tolist()]})

    def within(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("block")
        before, last = int(right["before"].iloc[0]), int(right["last"].iloc[0])
        found = borders([square(m) for m in left["matrix"]], before, last)
        return pd.DataFrame({"conv": left["conv"], "block": left["block"], "before": [before, *found[:-1]], "last": found})

    blocks = blocks.withColumn("run", F.floor(F.col("block") / CHAIN))
    runs = chained(written(blocks.groupBy("conv", "run").applyInPandas(run_of, MATRIX), "chat-runs")).withColumnRenamed("block", "run")
    return blocks.groupBy("conv", "run").cogroup(runs.groupBy("conv", "run")).applyInPandas(within, BORDERS)


def blocked(rows: DataFrame) -> DataFrame:
    """rows(conv, turn, line, text) with block: runs of about BLOCK lines of a transcript, in order.

    Lines are counted by turn and run of BLOCK line numbers first; these counts alone are summed along a transcript.
    """
    rows = rows.withColumn("part", F.floor(F.col("line") / BLOCK))
    parts = rows.groupBy("conv", "turn", "part").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("conv").orderBy("turn", "part").rowsBetween(Window.unboundedPreceding, 0))
    parts = parts.select("conv", "turn", "part", F.floor((upto - F.col("n")) / BLOCK).alias("block"))
    return rows.join(parts, ["conv", "turn", "part"]).drop("part")


def by_block(rows: DataFrame, each, schema: str) -> DataFrame:
    """What each makes of the sorted rows of every block (a frame) as rows: blocks pass one after another, a batch and a block at a time."""

    def run(frames):
        held = None
        for f in frames:
            if held is not None:
                f = pd.concat([held, f], ignore_index=True)
            keys = f["conv"].to_numpy(), f["block"].to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])])) if len(f) else np.zeros(0, int)
            if len(cuts) > 1:
                yield pd.concat([each(f.iloc[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)], ignore_index=True)
            held = f.iloc[cuts[-1] :] if len(cuts) else f
        if held is not None and len(held):
            yield each(held)

    return rows.repartition("conv", "block").sortWithinPartitions("conv", "block", "turn", "line", "text").mapInPandas(run, schema)


def roles(lines: DataFrame, conv_id: str = "conv_id", turn: str = "turn", line: str = "line", text: str = "text", model: Model = BY_HAND) -> DataFrame:
    """Per row of lines: conv_id, turn, line, role, starts_turn and content (the line without its marker).

    turn and line number a transcript's lines (whole numbers): turn the pieces it came in, line those
    within a piece; either may be the same everywhere. Rows with equal numbers follow their text, and
    stay in one block; a null number counts as 0, a null conv_id is a transcript of its own, a null
    text an empty line. Equal rows are all kept. A very long line is read for its marker, end and length
    only. Ties go to the lower state. Extra columns do not matter; an empty table gives an empty result.
    """
    bound_batches(lines.sparkSession)
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    rows = lines.select(F.col(conv_id).cast("long").alias("own"), number(turn).alias("turn"), number(line).alias("line"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # a transcript's key is its number, the text of it, or empty for none
    rows = written(blocked(rows.select(F.coalesce(F.col("own").cast("string"), F.lit("")).alias("conv"), "turn", "line", "text")), "chat-lines")
    step = model.step()

    def reduce_block(frame: pd.DataFrame) -> pd.DataFrame:
        texts = frame["text"].tolist()
        scores = emission(texts, False, model)
        opened = np.concatenate([emission(texts[:1], True, model), scores[1:]])
        m = np.concatenate([best_matrix(scores, step), best_matrix(opened, step)[:1]])
        return pd.DataFrame({"conv": [frame["conv"].iloc[0]], "block": [frame["block"].iloc[0]], "matrix": [m.ravel().tolist()]})

    def decode_block(frame: pd.DataFrame) -> pd.DataFrame:
        before, last, texts = int(frame["before"].iloc[0]), int(frame["last"].iloc[0]), frame["text"].tolist()
        states = decode(emission(texts, before < 0, model), step, None if before < 0 else before, last)
        content = [marker_of(t)[1] if s % 2 == 0 else t for s, t in zip(states, texts, strict=True)]
        return pd.DataFrame({"conv": frame["conv"].to_numpy(), "turn": frame["turn"].to_numpy(), "line": frame["line"].to_numpy(), "role": [ROLES[s // 2] for s in states], "starts_turn": states % 2 == 0, "content": content})

    fixed = chained(written(by_block(rows, reduce_block, MATRIX), "chat-blocks"))
    out = by_block(rows.join(fixed, ["conv", "block"]), decode_block, "conv string, turn long, line long, role string, starts_turn boolean, content string")
    return out.select(F.when(F.col("conv") != "", F.col("conv").cast("long")).alias(conv_id), F.col("turn").alias(turn), F.col("line").alias(line), "role", "starts_turn", "content")


def rendered(parsed: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """parsed with canonical, each line as it stands in the canonical transcript: a turn's first line under its header. Joined by line ends in order they are the transcript.

    A header's <| in a line gets a bar more, so that no line can stand for a header; one bar less gives the line again.
    """
    header = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"))
    plain = F.replace("content", F.lit("<|"), F.lit("<||"))
    return parsed.withColumn("canonical", F.concat(F.when(F.col("starts_turn"), header).otherwise(F.lit("")), plain))
