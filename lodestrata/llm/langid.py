"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text is built. A text is parsed greedily into
the longest phrases that the automaton knows; with c phrases over n symbols and m training
symbols the cross entropy is c * log2(m) / n, and the language with the least wins. Symbols are the
UTF-8 bytes of lower-case letters, and one for all between words, so that no letter of any script is left out.

The automata are dense transition tables, so that a batch of whole texts is parsed side by side
with one table look-up a symbol. They are made from a bounded sample of labelled rows, read whole
(SAMPLE_DOCS documents a language, as far as TRAIN_SYMBOLS symbols go); their size does not grow with
the data, and they are shipped with the function.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.shared import bound_batches, give_back, held_out

#: Bounds of the training sample: documents of each language, and symbols of each language's automaton.
SAMPLE_DOCS, TRAIN_SYMBOLS = 60, 16_000
#: Texts of a batch from which on a step over all of them at once is faster than each by itself.
FEW = 16
#: Numbers of symbols: a byte that no training text has, and what lies between words. Bytes follow.
UNKNOWN, GAP = 0, 1
UNDETERMINED = "und"

_letters: list[np.ndarray] = []
_gap = re.compile(r"[\W\d_]+")


def letter_table() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        found = np.zeros(sys.maxunicode + 1, bool)
        found[[n for n in range(sys.maxunicode + 1) if unicodedata.category(chr(n))[0] == "L"]] = True
        _letters.append(found)
    return _letters[0]


def letter_bytes(text: str) -> bytes:
    """Lower-case UTF-8 of a text, with one space for each run of anything but letters."""
    text = text.lower()
    if not text.isascii():
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(letter_table()[codes], codes, 32).astype("<u4")
        text = codes.tobytes().decode("utf-32-le", "surrogatepass")
    return _gap.sub(" ", text).encode("utf-8", "surrogatepass")


def suffix_automaton(sequence: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings of sequence; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in sequence:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class Model:
    """Automata of all languages in one table.

    An entry of the table is (row of the next state) * 4 + phrases ended: 0 while the phrase goes
    on, 1 where it ends before the symbol, 1 more where the symbol itself is unknown.
    """

    def __init__(self, texts: dict[str, str]) -> None:
        self.langs = sorted(texts)
        coded = {lang: letter_bytes(texts[lang]) for lang in self.langs}
        known = sorted({b for text in coded.values() for b in text} - {32})
        self.width = len(known) + 2
        self.of_byte = np.full(256, UNKNOWN, np.uint8)
        self.of_byte[known] = np.arange(2, len(known) + 2)
        self.of_byte[32] = GAP
        steps, self.roots, self.bits, rows = [], [], [], 0
        for lang in self.langs:
            sequence = self.symbols(coded[lang])[:TRAIN_SYMBOLS]
            steps.append(suffix_automaton(sequence.tolist()))
            self.roots.append(rows * self.width)
            self.bits.append(float(np.log2(max(2, len(sequence)))))
            rows += len(steps[-1])
        kind = np.int32 if max(1, rows) * self.width * 4 < 2**31 else np.int64
        full = np.zeros((max(1, rows), self.width), kind)  # filled in place, for it is the largest thing here
        for root, step in zip(self.roots, steps, strict=True):
            first, table = root // self.width, full[root // self.width : root // self.width + len(step)]
            table[0] = root * 4 + 1  # unknown even at the root
            for c, to in step[0].items():
                table[0, c] = (first + to) * self.width * 4
            table[1:] = table[0] + 1  # a phrase ends, the symbol starts the next
            for s, out in enumerate(step):
                for c, to in out.items():
                    table[s, c] = (first + to) * self.width * 4
        self.table = full.ravel()
        del steps
        give_back()

    def symbols(self, text: bytes) -> np.ndarray:
        return self.of_byte[np.frombuffer(text, np.uint8)]

    def phrases(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Phrases by language (rows) of each sequence (columns)."""
        order = np.argsort([-len(s) for s in sequences], kind="stable")
        lengths = np.array([len(sequences[i]) for i in order], int)
        out = np.zeros((len(self.langs), len(sequences)), np.int32)
        if not len(self.langs) or not len(sequences) or not lengths[0]:
            return out
        flat = np.concatenate([sequences[i] for i in order])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # texts longer than each step
        roots = np.array(self.roots, self.table.dtype)[:, None]
        at = np.repeat(roots, len(sequences), 1)
        table, before = self.table, len(sequences)
        ended = np.zeros_like(out)
        for t, n in enumerate(active.tolist()):
            if n < before:
                out[:, n:before] = ended[:, n:] + (at[:, n:] != roots)
                at, ended, before = at[:, :n].copy(), ended[:, :n].copy(), n
            if n < FEW:  # the long ones that are left, one after another
                steps = memoryview(table)
                for j in range(n):
                    rest = flat[starts[j] + t : starts[j] + lengths[j]].tobytes()
                    for k in range(len(self.langs)):
                        here, count = int(at[k, j]), int(ended[k, j])
                        for c in rest:
                            got = steps[here + c]
                            count += got & 3
                            here = got >> 2
                        at[k, j], ended[k, j] = here, count
                break
            got = table[at + flat[starts[:n] + t].astype(table.dtype)]
            ended += got & 3
            at = got >> 2
        out[:, :before] = ended + (at != roots)
        result = np.zeros_like(out)
        result[:, order] = out
        return result

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text. Score: by how much the best cross entropy undercuts the next, 0 to 1."""
        langs, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        found, sequences = [], []
        for i, text in enumerate(texts):
            if text and (letters := letter_bytes(text)).strip():
                found.append(i)
                sequences.append(self.symbols(letters))
        if found and self.langs:
            entropy = self.phrases(sequences) * np.array(self.bits)[:, None] / np.array([len(s) for s in sequences])
            best = entropy.argmin(0)
            langs[found] = np.array(self.langs, object)[best]
            if len(self.langs) > 1:
                two = np.sort(entropy, 0)[:2]
                score[found] = np.clip(1 - two[0] / np.maximum(two[1], 1e-12), 0, 1)
            else:
                score[found] = 1.0
        return langs.tolist(), score


def whole_texts(texts: list[str]) -> list[str]:
    """Of the texts, in order, those that fit TRAIN_SYMBOLS together, each whole; where none does, the shortest, of which the automaton takes as much."""
    left, out = TRAIN_SYMBOLS, []
    for t in texts:
        if (n := len(letter_bytes(t)) + 1) <= left:
            left -= n
            out.append(t)
    return out or [min(texts, key=lambda t: (len(t), t))]


def train(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Model of the labelled rows that are not held out.

    Of each language the SAMPLE_DOCS documents with the least hash of their id, those over TRAIN_SYMBOLS characters last,
    are read whole, as far as whole_texts() goes; rows with a null text, language or id teach nothing. Rows that repeat count once.
    """
    taught = df.where(~held_out(doc_id) & F.col(lang).isNotNull() & (F.length(text) > 0))
    rows = taught.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("sign", F.xxhash64("text"))
    by_hash = Window.partitionBy("lang").orderBy(F.length("text") > TRAIN_SYMBOLS, F.xxhash64("id"), "id", "sign")
    signs = rows.withColumn("n", F.rank().over(by_hash)).where(F.col("n") <= SAMPLE_DOCS).select("id", "lang", "sign").distinct()
    chosen = rows.join(F.broadcast(signs), ["id", "lang", "sign"]).groupBy("id", "lang", "sign").agg(F.min("text").alias("text")).collect()  # SAMPLE_DOCS a language
    texts: dict[str, list[str]] = {}
    for r in sorted(chosen, key=lambda r: (r.lang, len(r.text) > TRAIN_SYMBOLS, r.sign, r.id)):
        texts.setdefault(r.lang, []).append(r.text)
    return Model({k: "\n".join(whole_texts(v)) for k, v in texts.items()})


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with lang_pred and score, of whole texts; row by row, no shuffle.

    A null text, or one without any letter, gives ``und`` and 0; so does every text under a model
    without languages. Ties go to the language first in order. A very long text is parsed whole, by itself at
    last. Columns of df named like a result are replaced. Repeated rows get equal results, an empty table none.
    """
    bound_batches(df.sparkSession)

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        langs, score = model.predict(texts.tolist())
        give_back()
        return pd.DataFrame({"lang_pred": langs, "score": score})

    own = "__lang"
    while own in df.columns:
        own += "_"
    got = df.withColumn(own, guess(F.col(text).cast("string")))
    return got.withColumns({"lang_pred": F.col(f"{own}.lang_pred"), "score": F.col(f"{own}.score")}).drop(own)


def predictions(df: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score; the model learns from df's own labelled rows."""
    model = train(df)
    return identify(df.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
