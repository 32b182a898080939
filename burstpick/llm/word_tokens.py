"""Ids of whole texts under a tokenizer of the ``tokenizers`` library whose pieces never cross white space.

Splitting a text at ASCII white space and encoding each part gives the ids of the text, so a worker keeps the ids
of parts it has met (a bounded cache: beyond ``CACHE`` parts it starts anew) and encodes only new ones.
"""

from __future__ import annotations

import re
from itertools import islice

#: Parts that a worker remembers, and the most bytes of a part that it remembers.
CACHE, CACHE_BYTES = 400_000, 64
#: A text longer than so many bytes is split piecemeal.
LONG = 4 << 20

_PART = re.compile(rb"[^ \t-\r]+")
_CACHES: dict[str, WordIds] = {}


class WordIds(dict):
    """Part of a text (UTF-8) -> its ids, little-endian unsigned 32-bit."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        #: Characters that NFC leaves alone and that are lower-cased one by one, alike everywhere.
        self.plain = re.compile("[!-~\xa1-įı-ɏ]+")
        #: The tokenizer's own pattern (fixed value).
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        #: A byte stands for itself where it is printable in Latin-1, else for the next character from 256 on.
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        self.byte_chars = {b: 256 + n for n, b in enumerate(rest)}
        self.model = self.tokenizer.model
        self.stems: dict[str, bytes] = {}

    def _stem_ids(self, stem: str) -> bytes:
        """Of one match of the pattern, lower-cased: the merges alone."""
        found = self.model.tokenize(stem.encode().decode("latin-1").translate(self.byte_chars))
        return b"".join(t.id.to_bytes(4, "little") for t in found)

    def _ids(self, text: str) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, part: bytes) -> bytes:
        text = part.decode()
        if len(part) > CACHE_BYTES or "<|" in text or not self.plain.fullmatch(text):
            ids = self._ids(text)
        else:
            found = []
            for stem in self.split.findall(text.lower()):
                if (x := self.stems.get(stem)) is None:
                    if len(self.stems) >= CACHE:
                        self.stems.clear()
                    x = self.stems[stem] = self._stem_ids(stem)
                found.append(x)
            ids = b"".join(found)
        if len(part) <= CACHE_BYTES:
            if len(self) >= CACHE:
                self.clear()
            self[part] = ids
        return ids

    def of_text(self, text: str) -> bytes:
        data = text.encode()
        if len(data) <= LONG:
            return b"".join(map(self.__getitem__, data.split()))
        parts, out = (m[0] for m in _PART.finditer(data)), []
        while block := list(islice(parts, 100_000)):
            out.append(b"".join(map(self.__getitem__, block)))
        return b"".join(out)


def word_ids(path: str) -> WordIds:
    """This worker's cache for the tokenizer at ``path``; it lives as long as the worker."""
    if path not in _CACHES:
        _CACHES[path] = WordIds(path)
    return _CACHES[path]
