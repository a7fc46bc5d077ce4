"""Token counts of whole texts, huge documents in overlapping chunks.

A tokenizer of the ``tokenizers`` library cuts a text into words from left to right and merges
inside words only. Where two chunks that overlap both start a word at the same character, right
after white space, and agree on the words around it, the scanner is in the same state in both:
what follows cannot depend on what came before. The left chunk is used up to there and the right
one from there on. If the overlap holds no such place it is doubled, at worst until the two
chunks are one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.shared import free_name, small_batches, text_of
from panelweave.llm.tokens import encoder

HUGE_CHARS = 65_536
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
#: Words in a row that two chunks must agree on, half of them on each side of the boundary.
AGREE_WORDS = 4


class _Chunk:
    """Tokens of ``text[start:end]`` and the words they belong to, with places in the whole text."""

    def __init__(self, tokenizer, text: str, start: int, end: int):
        found = tokenizer.encode(text[start:end], add_special_tokens=False)
        self.start, self.end = start, end
        self.ids = np.array(found.ids, dtype="<u4")
        words = np.array([-1 if w is None else w for w in found.word_ids], dtype=np.int64)
        places = np.array(found.offsets, dtype=np.int64).reshape(-1, 2) + start
        first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.zeros(0, dtype=np.int64)
        last = np.r_[first[1:], len(words)][: len(first)]
        self.first, self.last = first, last
        self.at = places[first, 0] if len(first) else first
        self.to = places[last - 1, 1] if len(first) else first

    def words(self, low: int) -> dict[int, int]:
        """Place of each word from ``low`` on, with its number."""
        k = int(np.searchsorted(self.at, low))
        return {int(p): i for i, p in enumerate(self.at[k:], k)}

    def same(self, i: int, other: _Chunk, j: int) -> bool:
        return (
            self.at[i] == other.at[j]
            and self.to[i] == other.to[j]
            and np.array_equal(self.ids[self.first[i] : self.last[i]], other.ids[other.first[j] : other.last[j]])
        )


def _boundary(text: str, left: _Chunk, right: _Chunk) -> tuple[int, int] | None:
    """Token numbers in both chunks of the stable boundary nearest the middle of the overlap."""
    mine, theirs = left.words(right.start), right.words(right.start)
    middle = (right.start + left.end) // 2
    half = AGREE_WORDS // 2
    for place in sorted(mine.keys() & theirs.keys(), key=lambda p: abs(p - middle)):
        i, j = mine[place], theirs[place]
        if i < half or j < half or i + half >= len(left.at) or j + half >= len(right.at):
            continue  # the last word of a chunk may have been cut
        if text[place - 1].isspace() and all(left.same(i + d, right, j + d) for d in range(-half, half)):
            return int(left.first[i]), int(right.first[j])
    return None


def resynchronised_ids(tokenizer, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[np.ndarray]:
    """Ids of the whole text in runs, from chunks of about ``chunk`` characters."""
    size = len(text)
    chunk = max([chunk, *(len(t.content) for t in tokenizer.get_added_tokens_decoder().values())])  # one of two chunks holds a special string whole
    left, begin = _Chunk(tokenizer, text, 0, min(size, chunk)), 0
    while left.end < size:
        width, cut = overlap, None
        while cut is None and width < left.end - left.start:
            right = _Chunk(tokenizer, text, left.end - width, min(size, left.end - width + chunk + width))
            cut = _boundary(text, left, right)
            width *= 2
        if cut is None or cut[0] < begin:
            # No common boundary: both chunks become one, which begins where the last run ended.
            start = left.start
            if begin and begin < len(left.ids):
                start = int(left.at[np.searchsorted(left.first, begin)])
                begin = 0
            elif begin:
                start, begin = left.start, begin
            left = _Chunk(tokenizer, text, start, min(size, left.end + max(chunk, left.end - left.start)))
            continue
        yield left.ids[begin : cut[0]]
        left, begin = right, cut[1]
    yield left.ids[begin:]


def count_ids(path: str, texts: list[str], huge: int = HUGE_CHARS, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[int]:
    """Tokens of each text."""
    if path.endswith(".model"):
        return [len(ids) for ids in _pieces(path).encode(texts, num_threads=1)]
    enc = encoder(path)
    out = [0] * len(texts)
    small = [i for i, t in enumerate(texts) if len(t) <= huge]
    for i, ids in zip(small, enc.encode([texts[i] for i in small]), strict=True):
        out[i] = len(ids) // 4
    for i, t in enumerate(texts):
        if len(t) > huge:
            out[i] = sum(len(run) for run in resynchronised_ids(enc.tokenizer, t, chunk, overlap))
    return out


@cache
def _pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def token_counts(
    docs: DataFrame,
    path: str,
    text: str = "text",
    limit: int = 2048,
    huge: int = HUGE_CHARS,
    chunk: int = CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit instead of the text.

    ``path`` names a file of the ``tokenizers`` library (.json) or of sentencepiece (.model), which
    every executor must have. No special token is added; special strings inside a text count as the
    library counts them. A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted
    each; an empty table gives an empty result. Columns of ``docs`` that already have a result's name
    are replaced.
    """
    small_batches(docs.sparkSession)
    n = free_name(docs, "n")

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(count_ids(path, batch.tolist(), huge, chunk, overlap), dtype="int64")

    out = docs.withColumn(n, counted(text_of(text)))
    bytes_ = F.octet_length(text_of(text)).cast("long")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in {text, "n_bytes", "n_tokens", "over_limit"}]
    return out.select(*rest, bytes_.alias("n_bytes"), F.col(n).alias("n_tokens"), (F.col(n) > limit).alias("over_limit"))
