"""BPE encoding and decoding of whole texts.

Merges run from a priority queue of merge ranks over a doubly linked symbol list; queue entries
whose symbols have changed meanwhile are skipped as stale. Decoding joins vocabulary strings.

Each white-space separated chunk and each piece of one is encoded once and remembered in one bounded cache
of the task: what is a piece by itself has the same ids as a chunk and as a part of one.
The text rules are those of the vocabulary file: NFC, white space dropped, lower case, special
tokens cut out first, pieces by the file's pattern, one vocabulary string per byte with a word end.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.shared import bound_batches, give_back

#: Chunks and pieces remembered by a task in each of two generations (about 250 bytes each), and
#: the longest one worth remembering.
CACHE_ENTRIES, CACHE_CHARS = 250_000, 64
#: Factors that put two symbols, and a rank and a place in a piece, into one number.
PAIR, PLACES = 1 << 32, 1 << 40
#: Unicode's White_Space characters.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else from 256 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return letters


class Remembered(dict):
    """A cache of two generations: when the young one is full it becomes the old one, which is dropped."""

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.old = most, {}

    def recall(self, key: str) -> bytes | None:
        """What is known of a key that the young generation lacks; it becomes young again."""
        if (found := self.old.get(key)) is not None:
            self.keep(key, found)
        return found

    def keep(self, key: str, value: bytes) -> None:
        if len(key) <= CACHE_CHARS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value


class WordBpe:
    """Encoder and decoder of one vocabulary file in the JSON format of the tokenizers library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {self.vocab[a] * PAIR + self.vocab[b]: n for n, (a, b) in enumerate(merges)}
        self.made = [self.vocab[a + b] for a, b in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {n: s.encode() for s, n in [*self.vocab.items(), *self.special.items()]}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.chunks = regex.compile(f"[^{SPACES}]+")
        self.odd = regex.compile("[\x1c-\x1f]")
        letters = byte_letters()
        self.symbols = [self.vocab.get(letters[b]) for b in range(256)]
        self.last_symbols = [self.vocab.get(letters[b] + self.end) for b in range(256)]
        self.known = Remembered(CACHE_ENTRIES)

    def merged(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, lowest rank first and leftmost first among equals."""
        n = len(symbols)
        sym, prev, nxt = symbols, list(range(-1, n - 1)), [*range(1, n), -1]
        rank_of, made, push, pop = self.ranks.get, self.made, heapq.heappush, heapq.heappop
        # a queue entry is a rank and the place of the left symbol in one number
        queue = [r * PLACES + i for i in range(n - 1) if (r := rank_of(sym[i] * PAIR + sym[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            rank, left = divmod(pop(queue), PLACES)
            right = nxt[left]
            if right < 0 or sym[left] < 0 or rank_of(sym[left] * PAIR + sym[right]) != rank:
                continue  # stale
            new = sym[left] = made[rank]
            sym[right] = -1
            after = nxt[left] = nxt[right]
            if after >= 0:
                prev[after] = left
                if (r := rank_of(new * PAIR + sym[after])) is not None:
                    push(queue, r * PLACES + left)
            before = prev[left]
            if before >= 0 and (r := rank_of(sym[before] * PAIR + new)) is not None:
                push(queue, r * PLACES + before)
        return [s for s in sym if s >= 0]

    def piece_ids(self, piece: str) -> bytes:
        """Packed ids of a piece. One that holds < might be a special token as a chunk, and is not remembered."""
        known = self.known
        found = known.get(piece) if "<" not in piece else None
        if found is None and ("<" in piece or (found := known.recall(piece)) is None):
            data, of = piece.encode(), self.symbols
            symbols = [s for b in data[:-1] if (s := of[b]) is not None]
            if (last := self.last_symbols[data[-1]]) is not None:
                symbols.append(last)
            found = pack(f"<{len(out)}I", *out) if (out := self.merged(symbols)) else b""
            if "<" not in piece:
                known.keep(piece, found)
        return found

    def plain_ids(self, chunk: str) -> bytes:
        """Packed ids of a chunk without white space and special tokens. Lower case goes letter by letter."""
        chunk = (chunk if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ")).lower()
        return b"".join([self.piece_ids(piece) for piece in self.pieces.findall(chunk)])

    def chunk_ids(self, chunk: str) -> bytes:
        if "<" not in chunk:
            return self.plain_ids(chunk)
        out, at = [], 0
        for m in self.cut.finditer(chunk):
            out += [self.plain_ids(chunk[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.plain_ids(chunk[at:])])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known = self.known
        chunks = self.chunks.findall(text) if self.odd.search(text) else text.split()
        out = [known.get(chunk) for chunk in chunks]
        if None in out:
            for i, chunk in enumerate(chunks):
                if out[i] is None and (got := known.recall(chunk)) is not None:
                    out[i] = got
                elif out[i] is None:
                    out[i] = got = self.chunk_ids(chunk)
                    known.keep(chunk, got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings joined by a space, as a file without a decoder asks for; unknown ids are left out."""
        strings = self.strings
        try:
            return b" ".join([strings[n] for n in np.frombuffer(ids, "<u4").tolist()]).decode()
        except KeyError:
            return b" ".join([strings[n] for n in np.frombuffer(ids, "<u4").tolist() if n in strings]).decode()


_loaded: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """The worker's encoder for a vocabulary file, read once."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_decode(df: DataFrame, vocab_path: str, text: str = "text") -> DataFrame:
    """df with n_tokens (long), token_ids (binary, little-endian unsigned 32-bit) and decoded (string).

    vocab_path: a vocabulary file present on every executor. Row by row, no shuffle; memory is one
    Arrow batch and the bounded chunk cache. A null or empty text gives 0 tokens, empty ids and an
    empty string; a very long text is encoded whole. Columns of df named like a result are replaced; rows, ties and
    repeats stay as they are, and an empty table gives an empty result.
    """
    bound_batches(df.sparkSession)

    @F.pandas_udf("token_ids binary, decoded string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = loaded(vocab_path)
        try:
            for texts in batches:
                ids = [bpe.encode(t or "") for t in texts]
                yield pd.DataFrame({"token_ids": ids, "decoded": [bpe.decode(x) for x in ids]})
        finally:  # the worker goes on to other tasks, which may be of other operators
            bpe.known = Remembered(CACHE_ENTRIES)
            give_back()

    got = df.withColumn("__bpe", both(F.col(text).cast("string")))
    return got.withColumns({"token_ids": F.col("__bpe.token_ids"), "decoded": F.col("__bpe.decoded"), "n_tokens": (F.octet_length("__bpe.token_ids") / 4).cast("long")}).drop("__bpe")


def unpacked(df: DataFrame, token_ids: str = "token_ids") -> DataFrame:
    """df with the packed ids as array<int>, for consumers that want them so; null stays null."""

    @F.pandas_udf("array<int>")
    def ints(packed: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else np.frombuffer(x, "<u4").astype("i4").tolist() for x in packed], dtype=object)

    return df.withColumn(token_ids, ints(token_ids))


def digests(df: DataFrame, vocab_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens and SHA-256 digests of ids and decoded text."""
    got = encode_decode(df.select("doc_id", "text"), vocab_path)
    return got.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
