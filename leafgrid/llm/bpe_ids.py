"""Ids of whole texts by a byte-level BPE vocabulary file of the library tokenizers.

The file's vocabulary is run by tiktoken's merge loop, which gives the same ids as
the library that the file is for (a test compares them) at a fraction of its cost. Its
splitting pattern gives up on white space of about a million characters; the library itself
codes such a text. Strings of special tokens are ordinary text unless asked for, as the
vocabulary's description has it, so that a text cannot forge them.
"""

from __future__ import annotations

import json

import numpy as np

#: How such vocabularies split text before merging. Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_loaded: dict[str, "Encoder"] = {}


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Ids of texts, as arrays of unsigned 32-bit integers."""

    def __init__(self, path: str, special: bool = False) -> None:
        import tiktoken

        self.path, self.special = path, special
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = _byte_of()
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
        self.engine = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added if special else {})
        self.library = None

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        try:
            return self.engine.encode_to_numpy(text, allowed_special="all" if self.special else set(), disallowed_special=())
        except ValueError:
            return self._by_library(text)

    def _by_library(self, text: str) -> np.ndarray:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
            self.library.encode_special_tokens = not self.special
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str) -> Encoder:
    """The encoder of this worker process for a vocabulary file."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]
