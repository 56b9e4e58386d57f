"""Encoding of whole texts with a tokenizers file, chunk by chunk with a bounded cache.

No token crosses a chunk: chunks are runs of other characters than white space, with one space before them
where the tokenizer keeps spaces, and the white space left between them. Each distinct chunk is encoded once
by the library; a text is then the concatenation of its chunks' ids.
"""

from __future__ import annotations

import os
import re
import unicodedata
from functools import cache
from itertools import product

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: The Unicode property White_Space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Where no run of three spaces and line breaks occurs, each of them stands alone or before a word.
LONG_RUNS = ["".join(p) for p in product(" \n", repeat=3)]
END_RUNS = tuple("".join(p) for p in product(" \n", repeat=2))
CACHE_ENTRIES = 800_000
TEXTS_AT_ONCE = 8


@cache
def _stays_a_letter(c: str) -> bool:
    """Whether a letter is one letter after NFC and lower-casing; others end in a combining mark, as capital dotted I does."""
    c = unicodedata.normalize("NFC", c).lower()
    return len(c) == 1 and c.isalpha()


def _places_of_none(items: list):
    i = -1
    try:
        while True:
            i = items.index(None, i + 1)
            yield i
    except ValueError:
        return


class ChunkEncoder:
    def __init__(self, path: str, cache_entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.cache = cache_entries, {"": b""}
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.drops_space = ids(" a \n b") == ids("a") + ids("b")
        self.chunk = re.compile(f"[^{SPACE}]+" if self.drops_space else f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.other_space = re.compile(f"[\0{SPACE.replace(' ', '', 1).replace(chr(10), '')}]")
        self.line_break = (ids("\n") or [-1])[0]
        self.word_end = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.word_end[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def is_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text in order, perhaps with empty ones between them."""
        if self.drops_space:
            # str.split() parts at White_Space and at these four
            return self.chunk.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()
        if text.endswith(END_RUNS) or any(r in text for r in LONG_RUNS) or self.other_space.search(text):
            return self.chunk.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of whole texts; null has none. Chunks that are new to the cache are encoded once for all texts."""
        out = []
        for i in range(0, len(texts), TEXTS_AT_ONCE):
            out += self._encode_some(texts[i : i + TEXTS_AT_ONCE])
        return out

    def _encode_some(self, texts: list[str | None]) -> list[np.ndarray]:
        plain = [t if t and not self.is_special(t) else "" for t in texts]
        cache = self.cache
        parts = [self.chunks(t) for t in plain]
        found = [list(map(cache.get, p)) for p in parts]
        gaps = [list(_places_of_none(f)) for f in found]
        made = self.encode_chunks({p[i] for p, g in zip(parts, gaps, strict=True) for i in g})
        for p, f, g in zip(parts, found, gaps, strict=True):
            for i in g:
                f[i] = made[p[i]]
        ids = [np.frombuffer(b"".join(f), self.dtype) for f in found]
        # frequent chunks come early, so a full cache keeps what it has
        if len(cache) < self.limit:
            cache.update(made)
        for i, t in enumerate(texts):
            if t and not plain[i]:
                ids[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype)
        return ids

    def _apart(self, chunks):
        """Ids of chunks, and where each chunk's begin and end."""
        got = self.tokenizer.encode(chunks, is_pretokenized=True, add_special_tokens=False)
        ends = np.searchsorted(got.word_ids, np.arange(len(chunks) + 1)).tolist()
        return np.array(got.ids, self.dtype), ends[:-1], ends[1:]

    def _joined(self, chunks):
        """The same for letters only, faster: line breaks between them are tokens of their own, or words end with marked tokens."""
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(chunks)], add_special_tokens=False)[0].ids, self.dtype)
        marks = np.flatnonzero(self.word_end[ids] if self.drops_space else ids == self.line_break)
        if len(marks) != len(chunks) - (not self.drops_space):
            return self._apart(chunks)
        if self.drops_space:
            ends = (marks + 1).tolist()
            return ids, [0, *ends[:-1]], ends
        return ids, [0, *(marks + 1).tolist()], [*marks.tolist(), len(ids)]

    def encode_chunks(self, chunks: set[str]) -> dict[str, bytes]:
        """A letter that stays one and a punctuation mark after it never share a token, so 'word,' costs what 'word' does."""
        cut = [c for c in chunks if c[-1] in ".,;:!?" and len(c) > 1 and c[-2].isalpha() and _stays_a_letter(c[-2])]
        whole = chunks.difference(cut)
        whole.update([c[:-1] for c in cut], [c[-1] for c in cut])
        whole.difference_update(self.cache.keys() & whole)
        known, size = {}, self.dtype.itemsize
        letters = [c for c in whole if c.isalpha() or c[0] == " " and c[1:].isalpha()]
        for part, encode in ((letters, self._joined), (list(whole.difference(letters)), self._apart)):
            if part:
                ids, begins, ends = encode(part)
                data = ids.tobytes()
                known.update(zip(part, [data[a * size : b * size] for a, b in zip(begins, ends, strict=True)], strict=True))
        cache = self.cache
        for c in cut:
            head, tail = c[:-1], c[-1]
            known[c] = (known[head] if head in known else cache[head]) + (known[tail] if tail in known else cache[tail])
        return known


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder for each file in a Python worker."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]
