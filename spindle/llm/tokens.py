"""Token ids of whole texts with a ``tokenizers`` file, words memoised.

The pre-tokenizers of the supported files never let a token cross the start of
a word that follows a space, so a text is cut at its spaces, each distinct word
is encoded once by the library and its ids are kept. Texts in which that cut
would not be a token boundary, texts that hold the string of an added token
(one id, as the library has it), and words other than plain letters with plain
punctuation behind them, go through the library's whole pipeline.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

END_ID = 1
MEMO = 96 << 20     # bytes kept in all tables, in one task: the first words, so the frequent ones
ENTRY = 170         # bytes of an entry besides its characters and ids
INNER, UNCUT = re.compile(r" \s"), re.compile(r"\s \s")
PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]
PUNCTUATION = ".,;:!?*%$&#)|"


def as_bytes(ids: list[int]) -> bytes:
    return PACK[len(ids)](*ids) if len(ids) < len(PACK) else struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    return Encoder(path)


class Encoder:
    """``encode`` gives a text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        spec = json.loads(self.tok.to_str())
        self.vocab = self.tok.get_vocab_size()
        self.spaced = spec["pre_tokenizer"]["type"] == "ByteLevel"  # a word's space is part of its token
        self.lower = not self.spaced
        # byte-level alphabet: printable Latin-1 stays, the other bytes follow from 256 on
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: b for b in keep} | {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*keep}))}
        self.space = chr(self.alphabet[32])
        self.model = self.tok.model
        self.held = 0  # bytes of the three tables
        self.line_end = self.whole("\n") if self.spaced else b""
        self.first, self.rest = _Words(self, ""), _Words(self, " " if self.spaced else "")
        self.marked: dict[str, bytes] = {}  # runs of punctuation

    def whole(self, text: str) -> bytes:
        return as_bytes(self.tok.encode(text, add_special_tokens=False).ids)

    def piece(self, text: str, space: str = "") -> bytes:
        """A run of letters (with its space) or of punctuation: one call of the model."""
        if not text.isascii():  # ASCII stands for itself
            text = text.encode().decode("latin-1").translate(self.alphabet)
        return as_bytes([t.id for t in self.model.tokenize(space + text)])

    def punctuation(self, text: str) -> bytes:
        if (ids := self.marked.get(text)) is None:
            ids = self.piece(text)
            if self.held < MEMO:
                self.marked[text] = ids
                self.held += ENTRY + 2 * len(text) + len(ids)
        return ids

    def forget(self) -> None:
        """Empties the memos, as at the end of a task."""
        for table in (self.first, self.rest, self.marked):
            table.clear()
        self.held = 0

    def encode(self, text: str) -> bytes:
        # a space between two white spaces is no boundary where spaces are tokens
        if self.spaced and INNER.search(text) and UNCUT.search(text) or any(m in text for m in self.marks):
            return self.whole(text)
        head, *words = text.split(" ")
        return self.first[head] + b"".join(map(self.rest.__getitem__, words))

    def document(self, text: str | None) -> bytes:
        """Ids of a document: its text's and the end id."""
        return self.encode(text or "") + END_ID.to_bytes(4, "little")


class _Words(dict):
    """Ids of words, those with punctuation behind them included."""

    def __init__(self, enc: Encoder, space: str):
        super().__init__()
        self.enc, self.space = enc, space
        self.mapped, self.tokenize = enc.space if space else "", enc.model.tokenize

    def __missing__(self, chunk: str) -> bytes:
        enc = self.enc
        if chunk.isascii() and chunk.isalpha():  # most words
            ids = as_bytes([t.id for t in self.tokenize(self.mapped + (chunk.lower() if enc.lower else chunk))])
        else:
            word = chunk.rstrip(PUNCTUATION)
            if word.isalpha() and (word.isascii() or max(word) <= "ÿ"):
                if len(word) < len(chunk):
                    ids = self[word] + enc.punctuation(chunk[len(word):])
                else:
                    ids = enc.piece(word.lower() if enc.lower else word, self.mapped)
            elif "\n" in chunk and all(p and not p[0].isspace() and not p[-1].isspace() for p in chunk.split("\n")):
                head, *lines = chunk.split("\n")  # pairs of words seldom recur: only the words are kept
                return enc.line_end.join([self[head], *map(enc.first.__getitem__, lines)])
            else:
                ids = enc.whole(self.space + chunk)
        if enc.held < MEMO:
            self[chunk] = ids
            enc.held += ENTRY + 2 * len(chunk) + len(ids)
        return ids


def id_type(vocab: int) -> str:
    """The narrowest unsigned type that holds every id."""
    return "<u2" if vocab <= 1 << 16 else "<u4"
