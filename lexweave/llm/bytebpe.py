"""Byte-level BPE ids of whole texts, by the tokenizers library, with a bounded memo of words.

A pre-token of a byte-level BPE never holds a blank after its first character unless all of it is white
space, so a text can be cut before every blank that follows a character other than white space without
changing an id.  The pieces between such cuts repeat a great deal; their ids are kept, and the library's
model is asked only for pre-tokens that the memo does not hold.
"""

from __future__ import annotations

import re
from array import array

#: Memo entries before it is emptied and filled anew; bounds a worker's memory, has no effect on ids.
MEMO_ENTRIES = 400_000
#: Pieces longer than this are not kept.
MEMO_CHARS = 64
_CUT = re.compile(r"(?<!\s) ")
_UNSAFE = re.compile(r"\s ")

_encoders: dict[str, "ByteBpe"] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str | None = None) -> "ByteBpe":
    """The worker's encoder for a vocabulary file; kept for the life of the process."""
    path = path or vocabulary_path()
    if path not in _encoders:
        _encoders[path] = ByteBpe(path)
    return _encoders[path]


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class _Memo(dict):
    """A bounded memo of two generations: when the young one is full it becomes the old one, so frequent keys stay."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > MEMO_CHARS:
                return value
        if len(self) >= MEMO_ENTRIES:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class ByteBpe:
    """encode(text) gives a text's ids as little-endian unsigned 32-bit integers in bytes.

    None and the empty text give no ids. A text that holds the string of an added token goes to the library whole, so
    such strings become what the file says of them.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda _: None
        self.tokenize = self.tokenizer.model.tokenize
        self.alphabet = byte_alphabet()
        self.blank = self.alphabet[32]
        self.pre = regex.compile(public_tokenizers.PATTERN).findall
        self.after_blank = _Memo(self._after_blank)
        self.others = _Memo(self._pretoken)

    def _mapped(self, mapped: str) -> bytes:
        return array("I", [t.id for t in self.tokenize(mapped)]).tobytes()

    def _pretoken(self, piece: str) -> bytes:
        return self._mapped(piece.encode().decode("latin-1").translate(self.alphabet))

    def _plain(self, piece: str) -> bytes:
        return b"".join(map(self.others.__getitem__, self.pre(piece)))

    def _after_blank(self, word: str) -> bytes:
        if word.isalpha():
            return self._mapped(self.blank + word) if word.isascii() else self._pretoken(f" {word}")
        if word[-1:] in {".", ","} and word[:-1].isalpha():
            return self.after_blank[word[:-1]] + self.others[word[-1]]
        return self._plain(f" {word}")

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.added(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = _CUT.split(text) if _UNSAFE.search(text) else text.split(" ")
        if not first and rest:
            first, *rest = f" {rest[0]}", *rest[1:]
        return self._plain(first) + b"".join(map(self.after_blank.__getitem__, rest))
