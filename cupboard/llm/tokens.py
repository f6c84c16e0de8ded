"""Token ids of a byte-level BPE vocabulary, computed inside tasks."""

from __future__ import annotations

import json
import re
from functools import lru_cache

# Pieces that merges never cross, as the byte-level BPE family defines them (fixed value).
PIECE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

# Long texts are encoded in blocks of about this many characters.
BLOCK_CHARS = 1 << 20
# A space between two ASCII letters always begins a piece, so a text may be cut before it.
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as U+0100 onwards."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Encoder:
    """Encodes texts with the vocabulary of a ``tokenizers`` file.

    A plain byte-level BPE file, whose ids follow its merges, runs on the faster ``tiktoken`` merge loop with
    the same ids; any other file runs on ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._fast = self._plain_byte_bpe(json.loads(self._tokenizer.to_str()))

    @staticmethod
    def _plain_byte_bpe(spec: dict):
        import tiktoken

        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        plain = (
            model.get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space")
            and split.get("use_regex", True) and not spec.get("normalizer") and not model.get("dropout")
            and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
        )
        if not plain:
            return None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = [model["vocab"].get(a + b, -1) for a, b in merges]
        if ids != sorted(set(ids)) or (ids and ids[0] < 256):
            return None
        symbols = _byte_of_symbol()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(symbols[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("from_file", pat_str=PIECE_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def _ids(self, text: str) -> list[int]:
        if self._fast is None:
            return self._tokenizer.encode(text, add_special_tokens=False).ids
        return self._fast.encode(text, allowed_special="all", disallowed_special=())

    def encode(self, text: str) -> list[int]:
        if len(text) <= BLOCK_CHARS or self._fast is None:
            return self._ids(text)
        ids, start = [], 0
        while start < len(text):
            cut = _CUT.search(text, min(len(text), start + BLOCK_CHARS))
            end = cut.start() if cut else len(text)
            ids += self._ids(text[start:end])
            start = end
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file."""
    return Encoder(path)
