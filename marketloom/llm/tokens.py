"""Token ids of whole texts by the tokenizers library, one chunk between spaces at a time.

A chunk between ASCII white space is encoded on its own: neither the normaliser nor the
pre-tokeniser of the word tokenizer looks across white space, so the ids of the chunks,
joined, are the ids of the text. Each task keeps a bounded table of chunks it has met.
"""

from __future__ import annotations

import re
from array import array

from marketloom.llm.caches import remembered

END_ID = 1
END = END_ID.to_bytes(4, "little")
#: Chunks one Python worker remembers; further ones are encoded each time they occur.
CACHE_ENTRIES = 1_000_000

#: Control characters, rare kinds of space and letters beyond Latin Extended-A.
_UNUSUAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\u0130\u0149\u017f-\U0010ffff]")
_SPACE = re.compile("[ \t\n\r]+")
#: Lower-case letters of which each is its own normal form and its own lower-case form.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: Such letters and then ASCII marks, which the pre-tokeniser takes as one piece.
_TAILED = re.compile("([a-zß-öø-ÿ]+)([!-&(-/:;=-@[-`{-~]+)")
#: Byte-level alphabets write the bytes of these letters' UTF-8 forms as these characters.
_BYTE_CHARS = {b: chr(b) for b in range(0xA1, 0x100) if b != 0xAD}
_BYTE_CHARS |= {b: chr(256 + i) for i, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}
_LETTERS = {i: "".join(_BYTE_CHARS[b] for b in chr(i).encode()) for i in range(0xDF, 0x100)}


class ChunkIds(dict):
    """Little-endian unsigned 32-bit ids of a chunk; a miss asks the tokenizer."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.entries = entries

    def _encode(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk):
            tokens = self.model.tokenize(chunk if chunk.isascii() else chunk.translate(_LETTERS))
            return array("I", [t.id for t in tokens]).tobytes()
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        parts = _TAILED.fullmatch(chunk)
        ids = self[parts[1]] + self[parts[2]] if parts else self._encode(chunk)
        if len(self) < self.entries:
            self[chunk] = ids
        return ids


def chunk_ids(path: str) -> ChunkIds:
    return remembered(("chunks", path), lambda: ChunkIds(path))


def chunks_of(text: str) -> list[str]:
    """Chunks between white space, lower-cased where that is one letter for one letter."""
    if _UNUSUAL.search(text):
        return _SPACE.split(text)
    low = text.lower()
    return (low if len(low) == len(text) else text).split()


def encode_text(cache: ChunkIds, text: str | None) -> bytes:
    """Ids of a whole text (null: of the empty text) followed by the end id, as bytes."""
    return b"".join(map(cache.__getitem__, chunks_of(text))) + END if text else END
