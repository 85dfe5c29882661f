"""Token ids of words under public vocabularies, kept per word: texts repeat their words, tokenizers do not cross the white space between them."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import regex

#: Words kept in a worker; bounds its memory at some 60 MB. When full, all go.
KEPT = 300_000


class WordIds(dict):
    """bytes of a word -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, encode: Callable[[bytes], list[int]], limit: int = KEPT):
        super().__init__()
        self.encode, self.limit = encode, limit

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        got = np.array(self.encode(word), "<u4").tobytes()
        if len(word) < 64:
            self[word] = got
        return got

    def text(self, text: bytes) -> bytes:
        """Ids of a whole text."""
        return b"".join(map(self.__getitem__, text.split()))


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for characters from U+0100 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: The split pattern and the word end of the word-level vocabulary.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"

_made: dict[tuple[str, str], WordIds] = {}


def word_bpe(path: str) -> WordIds:
    """Ids of a `tokenizers` file with word ends, lower case and dropped white space.

    Latin words go through a byte-pair coder in which the byte FF, which no UTF-8 text has, stands for the word end; all others
    through the tokenizer itself, as do words that hold the string of a special token, which the tokenizer reads as that token.
    """
    if ("word", path) in _made:
        return _made["word", path]
    from tiktoken._tiktoken import CoreBPE
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    byte_of = _byte_of_char()
    ranks = {}
    for token, rank in model["vocab"].items():
        body, end = (token[: -len(WORD_END)], b"\xff") if token.endswith(WORD_END) else (token, b"")
        if all(c in byte_of for c in body) and not token.startswith("<|"):
            ranks[bytes(byte_of[c] for c in body) + end] = rank
    core = CoreBPE(ranks, {}, WORD_PATTERN)
    pieces = regex.compile(WORD_PATTERN).findall

    def encode(word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        if "<|" in text or max(text) >= "ɐ" or "\x1c" <= min(text) <= "\x1f" or "\x85" in text or "\xa0" in text:
            return whole.encode(text, add_special_tokens=False).ids
        out: list[int] = []
        for piece in pieces(text.lower()):
            out += core.encode_single_piece(piece.encode() + b"\xff")
        return out

    _made["word", path] = WordIds(encode)
    return _made["word", path]


def piece_bpe(path: str) -> WordIds:
    """Ids of a `sentencepiece` model, word by word: each word counts with the space before it."""
    if ("piece", path) not in _made:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        _made["piece", path] = WordIds(lambda word: model.encode(word.decode("utf-8", "replace")))
    return _made["piece", path]


def byte_pieces(path: str) -> tuple[int, int]:
    """First and last id of the byte fallback pieces of a `sentencepiece` model."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if model.is_byte(i)]
    return (ids[0], ids[-1]) if ids else (-1, -1)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
