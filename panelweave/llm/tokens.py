"""Token ids of texts, inside a task."""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable
from functools import cache

from panelweave.llm.shingles import forget

#: Pieces whose ids a worker keeps; the table starts anew when it is full.
MEMO_PIECES = 400_000


_SWAP = sys.byteorder == "big"
#: Normaliser and word pattern under which plain text can be cut here, by the same rule.
PLAIN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PLAIN_PATTERN = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}
#: Any but western letters, digits and signs, none of which composes or opens a special string, and the space that pieces are split at.
ODD = re.compile(r"[^A-Za-zÀ-ÖØ-öø-ÿ0-9!-;=-~ ]")
PLAIN_RUNS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^a-zß-öø-ÿ0-9 ]+")


def load(path: str):
    """A tokenizer of the ``tokenizers`` library; special strings in a text keep the library's default."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker a core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def splits_at_spaces(tokenizer) -> bool:
    """Whether the ids of a text are those of its space-separated pieces, one after the other.

    True for tokenizers that drop white space before they merge: then no token, and no rule
    that joins characters, reaches over a space.
    """
    pre = tokenizer.pre_tokenizer
    if pre is None or any(" " in t.content or "\n" in t.content or t.lstrip or t.rstrip for t in tokenizer.get_added_tokens_decoder().values()):
        return False
    probes = {
        "ab cd": [("ab", (0, 2)), ("cd", (3, 5))],
        " ab\n cd ": [("ab", (1, 3)), ("cd", (5, 7))],
    }
    return all(pre.pre_tokenize_str(k) == v for k, v in probes.items()) and tokenizer.encode("", add_special_tokens=False).ids == []


def _parts(text: str) -> tuple[list[str], list[str]]:
    """Stretches of plain pieces, which may be empty, and the pieces between them that hold an odd character."""
    plain, pieces, at = [], [], 0
    for odd in ODD.finditer(text):
        here = odd.start()
        if here >= at:
            start, end = text.rfind(" ", at, here) + 1 or at, text.find(" ", here)
            end = len(text) if end < 0 else end
            plain.append(text[at:start])
            pieces.append(text[start:end])
            at = end
    return [*plain, text[at:]], pieces


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte of a letter above ASCII in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class _Runs(dict):
    """Ids of runs; those of a run not held yet are made and kept."""

    def __init__(self, made: Callable[[str], bytes]):
        self.made = made

    def __missing__(self, run: str) -> bytes:
        ids = self[run] = self.made(run)
        return ids


class Encoder:
    """Ids as the library gives them for the whole text, without added special tokens.

    Words repeat, so where a tokenizer splits at spaces the ids of each piece are computed
    once and kept; other tokenizers encode the whole text. Where the word pattern is the known
    one, stretches of plain pieces are cut into runs here, and each new run goes to the library's
    merge model: runs repeat more than pieces, and the model alone is cheaper than the whole chain.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.by_piece = splits_at_spaces(self.tokenizer)
        rules = json.loads(self.tokenizer.to_str())
        before = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.plain = (
            self.by_piece
            and rules["normalizer"] == PLAIN_NORMALIZER
            and [p["type"] for p in before] == ["Split", "ByteLevel"]
            and (before[0]["pattern"], before[0]["behavior"], before[0]["invert"]) == (PLAIN_PATTERN, "Removed", True)
            and not (before[1]["add_prefix_space"] or before[1]["use_regex"])
        )
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.runs = _Runs(self._run)
        self.memo: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers."""
        if not self.by_piece:
            return [self._pack(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        texts = [t.replace("\n", " ") for t in texts]
        if not self.plain:
            split = [t.split(" ") for t in texts]
            self._learn({w for words in split for w in words})
            return [b"".join(map(self.memo.__getitem__, words)) for words in split]
        parts = [_parts(t) for t in texts]
        self._learn({w for _, words in parts for w in words})
        return [b"".join([ids for s, w in zip(plain[:-1], words, strict=True) for ids in (*self._plain(s), self.memo[w])] + self._plain(plain[-1])) for plain, words in parts]

    def _plain(self, stretch: str) -> list[bytes]:
        if len(self.runs) > MEMO_PIECES:
            self.runs.clear()
        return list(map(self.runs.__getitem__, PLAIN_RUNS.findall(stretch.lower())))

    def _learn(self, pieces: set[str]) -> None:
        new = list(pieces - self.memo.keys())
        if len(self.memo) + len(new) > MEMO_PIECES:
            self.memo.clear()
            new = list(pieces)
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.memo[w] = self._pack(e.ids)

    def _run(self, run: str) -> bytes:
        shown = run if run.isascii() else "".join(map(self.letters.__getitem__, run.encode()))
        return self._pack([t.id for t in self.model.tokenize(shown)])

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        packed = array("I", ids)
        if _SWAP:
            packed.byteswap()
        return packed.tobytes()


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def encoder(path: str) -> Encoder:
    """One encoder for each worker process. Workers outlive a stage, so word hashes of one before are freed."""
    forget()
    return _encoder(path)
