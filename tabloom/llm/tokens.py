"""Token ids by a public tokenizer file, word by word.

The tokenizer drops white space before it merges, so no token crosses a blank:
the ids of a text are those of its blank-separated words in a row. Texts of plain
Latin letters, digits and punctuation are cut into the tokenizer's pieces, whose
normal form is their lower case, and each piece goes to the library's merge model
once per memo. The words of all other texts, and of texts that could hold a special
string, go through the library as they are, once per memo.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import tokenizers

from .common import Memo

#: Words, and pieces of words, that a worker keeps the ids of.
MEMO_WORDS = 400_000

#: Characters of tokens that end a sentence.
SENTENCE_END = frozenset(".!?")
CLOSERS = frozenset("\"')]")


@lru_cache(maxsize=4)
def load(path: str) -> tokenizers.Tokenizer:
    tokenizer = tokenizers.Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def version(path: str) -> str:
    """Digest of the tokenizer's file and library, the second key of stored counts."""
    with open(path, "rb") as file:
        content = hashlib.sha256(file.read()).hexdigest()
    return f"{content[:32]}-tokenizers-{tokenizers.__version__}"


#: Texts whose normal form is their lower case: nothing to compose.
_PLAIN = re.compile("[\\t\\n\\v\\f\\r !-~À-ÖØ-öø-įı-ſ]*")
#: Fixed value: the tokenizer's pieces, for lower-cased plain texts.
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^ \\t\\n\\v\\f\\ra-z0-9ß-öø-ſ]+")


def _byte_characters() -> list[str]:
    """Visible character for each byte: itself if visible, else the next free one from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(free)) for b in range(256)]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=4)
def _memos(path: str) -> tuple[Memo, Memo]:
    """Little-endian unsigned 32-bit ids of plain pieces, and of any word without blanks."""
    tokenizer, shown = load(path), _byte_characters()
    merge, whole = tokenizer.model.tokenize, tokenizer.encode

    def piece_ids(piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join([shown[b] for b in piece.encode()])
        return _packed([t.id for t in merge(piece)])

    def word_ids(word: bytes) -> bytes:
        text = word.decode("utf-8", "surrogatepass")
        return _packed(whole(text, add_special_tokens=False).ids)

    return Memo(piece_ids, MEMO_WORDS), Memo(word_ids, MEMO_WORDS)


def ids_bytes(text: str, path: str) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    pieces, words = _memos(path)
    if "<|" not in text and _PLAIN.fullmatch(text):
        return b"".join(map(pieces.__getitem__, _PIECES.findall(text.lower())))
    # Split at the six ASCII blanks only: other separators may be tokens.
    return b"".join(map(words.__getitem__, text.encode("utf-8", "surrogatepass").split()))


def count(text: str, path: str) -> int:
    return len(ids_bytes(text, path)) // 4


@lru_cache(maxsize=4)
def sentence_ends(path: str) -> np.ndarray:
    """True at ids of tokens that end a sentence."""
    vocabulary = load(path).get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    for token, i in vocabulary.items():
        marks = set(token.removesuffix("</w>"))
        if marks & SENTENCE_END and marks <= SENTENCE_END | CLOSERS:
            ends[i] = True
    return ends
