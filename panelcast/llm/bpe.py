"""Byte-pair token ids of whole texts.

The ids are those of ``tokenizers`` with the given vocabulary file. Texts of basic, Latin-1 and extended Latin characters
go through the same vocabulary in its rank form, which needs a quarter of the processor time; all other texts go through
``tokenizers`` itself. Tests compare both.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache

import numpy as np

_LATIN = re.compile("[\x00-ɏ]*")
# The public pattern, and one that cuts alike in less time: it has no look-ahead, which needs a slower matcher. What the look-ahead
# does, leaving a word the last character of the white space before it, is done by ``_parts``.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_QUICK_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
# White space among these characters, as both patterns see it: U+001C to U+001F are none, unlike in Python.
_SPACES = "\t-\r \x85\xa0"
_LAST_SPACE = re.compile(f"[{_SPACES}](?=[{_SPACES}][^{_SPACES}])")
# Bytes to a space where they may belong to white space in UTF-8 (U+0085 and U+00A0 begin with C2).
_MAYBE_SPACE = bytes(0x20 if b in b"\t\n\v\f\r \x85\xa0\xc2" else 0x78 for b in range(256))


def _parts(text: str) -> list[str]:
    """A text cut before the last character of every longer run of white space that a word follows."""
    if b"  " not in text.encode().translate(_MAYBE_SPACE):
        return [text]
    cuts = [0, *(m.end() for m in _LAST_SPACE.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


class Encoder:
    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.encode_special_tokens = True  # their strings in a text are ordinary text
        self.quick, self.cut = None, pattern == _PATTERN
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            # Without any special token tiktoken looks for an empty one at every character; this one is ordinary text below.
            self.quick = tiktoken.Encoding(
                "ranks", pat_str=_QUICK_PATTERN if self.cut else pattern, mergeable_ranks=table,
                special_tokens={"<|endoftext|>": len(table)})

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; none for NULL."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.quick and (text.isascii() or _LATIN.fullmatch(text)):
            ids = [self.quick.encode_to_numpy(t, disallowed_special=()) for t in (_parts(text) if self.cut else [text])]
            return (ids[0] if len(ids) == 1 else np.concatenate(ids)).astype(np.uint32, copy=False)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str | None = None, pattern: str | None = None) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path, ranks, pattern)


@lru_cache(maxsize=2)
def byte_lengths(path: str) -> np.ndarray:
    """Number of text bytes that each id stands for; in a byte-level vocabulary every character is one byte."""
    from tokenizers import Tokenizer

    vocab = Tokenizer.from_file(path).get_vocab()
    out = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        out[i] = len(token)
    return out


def public_files() -> dict[str, str]:
    """The public vocabulary as arguments of ``encoder``; called where the code runs, as places differ by machine."""
    import public_tokenizers

    return {
        "path": public_tokenizers.path("byte_bpe_50k.json"),
        "ranks": public_tokenizers.path("byte_bpe_50k.tiktoken"),
        "pattern": public_tokenizers.PATTERN,
    }
