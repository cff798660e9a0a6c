"""Token ids of whole texts by a byte-level tokenizer, and the bytes each token covers.

The tokenizer's pattern never joins a space to what stands before it, so a text may be cut before
every space that follows something other than white space, and the pieces encoded one by one give
the ids of the whole text. Texts that hold an added token are not cut. A Python worker encodes each distinct piece once. Pieces of plain Latin
characters go through the rank form of the same vocabulary, which is faster and gives the same ids;
all others, and vocabularies whose merges are not ranks, through the tokenizer itself. The
vocabulary file is named by its path, which must exist on every executor.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from pathlib import Path

import numpy as np

from groundwork.llm.arrow import worker_state

#: Pieces remembered by a worker at most, and the longest of them.
MOST, LONGEST = 500_000, 64
_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")
#: Characters whose classes are the same in every version of Unicode.
_PLAIN = re.compile("[\\t\\n\\r -~\u00c0-\u024f]*")
#: Fixed value: the pattern of byte-level vocabularies that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes and ids, if the ids are the order of the merges under the usual pattern."""
    said = json.loads(Path(path).read_text())
    split, model = said.get("pre_tokenizer") or {}, said["model"]
    usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    if not usual or said.get("normalizer") or model.get("ignore_merges"):
        return None
    vocabulary, merges = model["vocab"], model["merges"]
    for i, merge in enumerate(merges):
        pair = merge.split(" ") if isinstance(merge, str) else merge
        if vocabulary.get("".join(pair)) != 256 + i:
            return None
    of = _bytes_of()
    return {bytes(of[c] for c in token): n for token, n in vocabulary.items() if n < 256 + len(merges)}


class _Known(dict):
    """Pieces after a space and their ids; a missing one is encoded."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(" " + piece)
        if len(piece) <= LONGEST:
            if len(self) >= MOST:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ids as little-endian 16-bit numbers (32-bit for larger vocabularies)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Texts that hold one of these go through the tokenizer whole.
        self.added = {t.content: n for n, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.holds = re.compile("|".join(map(re.escape, self.added))).search if self.added else lambda text: None
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.fast = None
        if ranks := _ranks(path):
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known = _Known(self.encode)

    @staticmethod
    def of(path: str) -> Encoder:
        """The worker's encoder for a vocabulary, with all pieces it knows by now."""
        encoders = worker_state("encoders")
        if path not in encoders:
            encoders[path] = Encoder(path)
        return encoders[path]

    def encode(self, text: str) -> bytes:
        if self.fast and _PLAIN.fullmatch(text):
            return array(self.code, self.fast(text)).tobytes()
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """All ids of ``text``, without special tokens."""
        if not text:
            return b""
        if self.holds(text):
            return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        pieces = _CUT.split(text) if _AFTER_SPACE.search(text) else text.split(" ")
        return self.encode(pieces[0]) + b"".join(map(self.known.__getitem__, pieces[1:]))

    def lengths(self) -> np.ndarray:
        """Bytes of each id: a byte-level vocabulary writes every byte as one character."""
        out = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, number in self.tokenizer.get_vocab().items():
            out[number] = len(token.encode()) if token in self.added else len(token)
        return out
