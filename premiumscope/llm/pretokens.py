"""Byte-level BPE of texts and of cached pieces of text.

The vocabulary file is read by ``tokenizers``, whose ids are the ones that count. Ordinary texts are coded by
the same vocabulary in ``tiktoken``, which gives the same ids several times faster (``tests/llm`` compares the
two). Texts with special-token strings or with characters outside the common Latin range, whose classes differ
between Unicode versions, go to ``tokenizers``.

Merges never cross the borders of pre-tokens, and a single blank before a non-blank always begins one. A text
without double blanks can therefore be cut at its blanks into pieces that are encoded once and then looked up.
"""

from __future__ import annotations

import os
import re

from premiumscope.llm.common import worker_cache

VOCABULARY = "byte_bpe_50k.json"
# Pieces a worker remembers; the cache is emptied beyond it, which bounds memory and never changes a result.
CACHE_PIECES = 300_000
_OUTSIDE = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u024f]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """Text -> ids of one vocabulary file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.special = sorted(added)
        byte = _byte_of_char()
        vocabulary = self.library.get_vocab(with_added_tokens=False).items()
        ranks = {bytes(byte[c] for c in token): rank for token, rank in vocabulary if token not in added}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def plain(self, text: str) -> bool:
        return not _OUTSIDE.search(text) and not any(s in text for s in self.special)

    def ids(self, text: str) -> list[int]:
        if self.plain(text):
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


def coder(path: str) -> Coder:
    cache = worker_cache("tokens")
    if ("coder", path) not in cache:
        cache["coder", path] = Coder(path)
    return cache["coder", path]


class PieceCache:
    """Number of tokens of a text, from a fixed table of known pieces and a cache of others."""

    def __init__(self, path: str, known: dict[str, int] | None = None):
        self.coder = coder(path)
        self.known = known or {}
        self.found: dict[str, int] = {}

    def count(self, text: str) -> int:
        if not text:
            return 0
        if "  " in text or not self.coder.plain(text):
            return len(self.coder.ids(text))
        first, *rest = text.split(" ")
        known, found, encode = self.known, self.found, self.coder.fast.encode_ordinary
        total = len(encode(first))
        for piece in rest:
            size = known.get(piece)
            if size is None:
                size = found.get(piece)
                if size is None:
                    size = len(encode(" " + piece))
                    if len(found) >= CACHE_PIECES:
                        found.clear()
                    found[piece] = size
            total += size
        return total
