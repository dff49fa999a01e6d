"""Token ids of whole texts by the tokenizers library.

Word by word: a single space, or a line feed, between two other characters that aren't white space always ends a
pre-token, so the pieces between them can be encoded by themselves and remembered. Texts where white space follows on
white space, or that hold a special token, are encoded as a whole. Both ways give the same ids (tests/llm compares them)."""

from __future__ import annotations

import os
import re

import numpy as np

PUBLIC = "byte_bpe_50k.json"
#: Remembered pieces of a worker, of each of two generations: when the younger is full, the elder goes. Bounds memory, not results.
REMEMBERED = 400_000
_LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([^\w\s]*)")
_RUN = re.compile(r"\s\s")


def public_path(name: str = PUBLIC) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_chars() -> dict[int, str]:
    """The characters that byte-level vocabularies use for bytes: printable ones stand for themselves, the others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}


class _Pieces(dict):
    """Ids of pieces as bytes (little-endian, 32 bits an id). lead: what stands before each piece in the text."""

    def __init__(self, coder: Coder, lead: str):
        super().__init__({"": coder.whole(lead) if lead else b""})
        self.coder, self.lead, self.elder = coder, lead, {}

    def __missing__(self, piece: str) -> bytes:
        c = self.coder
        if (ids := self.elder.get(piece)) is not None:
            pass
        elif (m := _LETTERS.fullmatch(piece)) and c.plain:
            ids = self[m[1]] + c.marks[m[2]] if m[2] else c.pre_token(self.lead + piece)
        else:
            ids = c.whole(self.lead + piece)
        if len(self) >= REMEMBERED:
            self.elder = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class _Marks(dict):
    def __init__(self, coder: Coder):
        self.coder = coder

    def __missing__(self, piece: str) -> bytes:
        self[piece] = ids = self.coder.whole(piece)
        return ids


class Coder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # by pieces only where the file says what the docstring relies on
        self.plain = self.tokenizer.normalizer is None and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and not self.tokenizer.pre_tokenizer.add_prefix_space and type(self.model).__name__ == "BPE"
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.table = {b: c for b, c in _byte_chars().items()}
        self.marks = _Marks(self)
        self.line = self.whole("\n")
        self.first, self.later = _Pieces(self, ""), _Pieces(self, " ")

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def pre_token(self, text: str) -> bytes:
        """Ids of text that is one pre-token."""
        written = text.replace(" ", self.table[32]) if text.isascii() else text.encode().decode("latin-1").translate(self.table)
        return np.array([t.id for t in self.model.tokenize(written)], "<u4").tobytes()

    def rest(self) -> None:
        """Between tasks the elder pieces go; frequent ones are among the younger."""
        self.first.elder, self.later.elder = {}, {}

    def ids(self, text: str) -> bytes:
        """Ids of a whole text, 4 little-endian bytes each."""
        if not text:
            return b""
        if not self.plain or _RUN.search(text) or any(x in text for x in self.specials):
            return self.whole(text)
        later, first = self.later.__getitem__, self.first
        lines = []
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            lines.append(first[head] + b"".join(map(later, rest)) if rest else first[head])
        return self.line.join(lines)


#: The worker's coders, one for each file, kept between tasks.
_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]
