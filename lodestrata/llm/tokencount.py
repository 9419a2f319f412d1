"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

A pre-token is a white-space separated word with a mark before it. The distinct new pre-tokens of a
batch are put in a trie; for each node the best score of its prefix, and the number of tokens on the
way, follow from its ancestors, so that a prefix is scored once however many words share it. The
counts at terminal nodes are stored, and a text's count is the sum over its words.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.shared import bound_batches

#: Counts remembered by a worker before it starts anew, and the longest pre-token remembered.
CACHE_WORDS, CACHE_CHARS = 400_000, 64
#: Words of one trie (its nodes take about 2 kB a word).
TRIE_WORDS = 20_000
#: The mark before a pre-token, and how much worse than the worst piece an unknown character is.
SPACE_MARK, UNKNOWN = "▁", 10.0


class Unigram:
    """Pieces with log scores; the best split of a pre-token has the highest sum, then the fewest tokens.

    A character that no piece covers counts as one token of UNKNOWN below the lowest score.
    """

    def __init__(self, pieces: dict[str, float]) -> None:
        self.trie: dict = {}
        for piece, score in pieces.items():
            node = self.trie
            for ch in reversed(piece):  # pieces are looked up from their end, along a prefix's ancestors
                node = node.setdefault(ch, {})
            node[""] = score
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN
        self.known: dict[str, int] = {}

    def counts(self, words: list[str]) -> dict[str, int]:
        """Tokens of each distinct word, all from one trie of the words."""
        root: dict = {}
        out: dict[str, int] = {}
        for word in words:
            node = root
            for ch in SPACE_MARK + word:
                node = node.setdefault(ch, {})
            node[""] = word  # no character is the empty string
        # depth first; along the path from the root: characters, best scores and token counts
        path: list[str] = []
        best: list[tuple[float, int]] = [(0.0, 0)]
        stack: list[tuple[int, str, dict]] = [(0, ch, child) for ch, child in root.items()]
        while stack:
            depth, ch, node = stack.pop()
            del path[depth:], best[depth + 1 :]
            path.append(ch)
            best.append(self.forward(path, best))
            for key, child in node.items():
                if key == "":
                    out[child] = best[-1][1]
                else:
                    stack.append((depth + 1, key, child))
        return out

    def forward(self, path: list[str], best: list[tuple[float, int]]) -> tuple[float, int]:
        """Best score and count of the prefix in path, from those of its own prefixes."""
        end = len(path)
        score, count = best[end - 1]
        top = (score + self.unknown, -(count + 1))
        node, i = self.trie, end
        while i > 0 and (node := node.get(path[i - 1])) is not None:
            i -= 1
            if (piece := node.get("")) is not None:
                score, count = best[i]
                top = max(top, (score + piece, -(count + 1)))
        return top[0], -top[1]

    def total(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Tokens and pre-tokens of each text."""
        split = [(t or "").split() for t in texts]
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        fresh = {w for words in split for w in words if w not in known}
        once = {w for w in fresh if len(w) > CACHE_CHARS}  # held for this batch only
        fresh = sorted(fresh - once)
        for i in range(0, len(fresh), TRIE_WORDS):
            known.update(self.counts(fresh[i : i + TRIE_WORDS]))
        long = {w: self.alone(w) for w in once}
        return [sum([known[w] if w in known else long[w] for w in words]) for words in split], [len(words) for words in split]

    def alone(self, word: str) -> int:
        """Tokens of one long word, without a trie."""
        path, best = [], [(0.0, 0)]
        for ch in SPACE_MARK + word:
            path.append(ch)
            best.append(self.forward(path, best))
        return best[-1][1]


_models: dict[str, Unigram] = {}


def loaded(path: str) -> Unigram:
    """The worker's model of a sentencepiece vocabulary: its ordinary pieces and their scores."""
    if path not in _models:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = [n for n in range(sp.get_piece_size()) if not (sp.is_control(n) or sp.is_unknown(n) or sp.is_byte(n) or sp.is_unused(n))]
        # scores that only rank the pieces become log probabilities that fall with the rank
        _models[path] = Unigram(log_scores({sp.id_to_piece(n): sp.get_score(n) for n in ordinary}))
    return _models[path]


def log_scores(scores: dict[str, float]) -> dict[str, float]:
    """Scores as log probabilities: whole-number ranks, as of merges, by Zipf's law; others as they are."""
    import math

    if any(s != int(s) for s in scores.values()):
        return scores
    top = max(scores.values(), default=0.0)
    total = math.log(sum(1 / (2 + top - s) for s in scores.values()) or 1.0)
    return {p: -math.log(2 + top - s) - total for p, s in scores.items()}


def count_tokens(df: DataFrame, vocab_path: str, text: str = "text") -> DataFrame:
    """df with n_tokens and n_pretokens (long), of whole texts; row by row, no shuffle.

    vocab_path: a sentencepiece vocabulary present on every executor. A null, empty or blank text
    has 0 of both. Equal splits' ties go to fewer tokens. A very long text is counted whole, a very long word by
    itself. Repeated rows count alike; columns of df named like a result are replaced, and an empty table
    gives an empty result.
    """
    bound_batches(df.sparkSession)

    @F.pandas_udf("n_tokens long, n_pretokens long")
    def counted(texts: pd.Series) -> pd.DataFrame:
        tokens, words = loaded(vocab_path).total(texts.tolist())
        return pd.DataFrame({"n_tokens": tokens, "n_pretokens": words})

    got = df.withColumn("__count", counted(F.col(text).cast("string")))
    return got.withColumns({"n_tokens": F.col("__count.n_tokens"), "n_pretokens": F.col("__count.n_pretokens")}).drop("__count")
