"""Token ids of whole texts, by the tokenizers library.

``PieceEncoder`` remembers the ids of pieces.  For the lower-casing word tokenizers (normalisers NFC, white space
to space, lower case; words split by the fixed pattern below; merges that never cross words) the ids of a text are
the ids of its pieces, each encoded by the library once.  Text with characters outside the plain set is cut at ASCII white
space only, and texts with the strings of special tokens go to the library whole.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Pieces to remember in a worker; beyond it the memory is dropped and built anew.
CACHE_PIECES = 600_000

# Fixed value: the split pattern of the word tokenizer's file.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# On the plain set the same pieces by the standard library.
_PLAIN_LETTERS = "a-zA-ZÀ-ÖØ-öø-ÿ"
_UNPLAIN = re.compile(rf"[^\t\n\x0b\x0c\r\x20-\x7e{_PLAIN_LETTERS}]")
_PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_PLAIN_LETTERS}]+|[0-9]|[^\s0-9{_PLAIN_LETTERS}]+")


# The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}


class _Pieces(dict):
    """Ids of pieces; a piece not yet known is encoded by the library's merges."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer, self.merge = tokenizer, tokenizer.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        if _UNPLAIN.search(piece):
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        elif piece.isascii():
            ids = [t.id for t in self.merge(piece)]
        else:
            ids = [t.id for t in self.merge(piece.encode().decode("latin-1").translate(_ALPHABET))]
        self[piece] = out = struct.pack(f"<{len(ids)}I", *ids)
        return out


class PieceEncoder:
    """ids(text): the ids as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, name: str = TOKENIZER):
        path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.by_piece = spec["model"].get("end_of_word_suffix") == "</w>" and pre[0].get("pattern", {}).get("Regex") == WORD_PATTERN
        self.cache = _Pieces(self.tokenizer)

    def pieces(self, text: str) -> list[str]:
        if not _UNPLAIN.search(text):
            return _PIECE.findall(text.lower())
        out = []
        for chunk in re.split(r"[\t\n\x0b\x0c\r ]+", text):
            out += [chunk] * bool(chunk) if _UNPLAIN.search(chunk) else _PIECE.findall(chunk.lower())
        return out

    def ids(self, text: str) -> bytes:
        if not self.by_piece or any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        return b"".join(map(self.cache.__getitem__, self.pieces(text)))


@lru_cache(maxsize=4)
def encoder(name: str = TOKENIZER) -> PieceEncoder:
    """One encoder a worker process; Spark reuses its workers, so pieces are remembered across tasks."""
    return PieceEncoder(name)
