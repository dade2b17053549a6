"""Token ids of whole texts, by a public tokenizer.

Prose repeats its words, so each chunk between blanks is encoded once and remembered. That
is exact for tokenizers that drop white space and never join what it separates; of others
the whole text is encoded at once.
"""

import json
import re
from functools import lru_cache

from tokenizers import Tokenizer

from dagtrail.llm.common import only, remembers

# Chunks remembered by one worker, about 200 bytes each; later ones are encoded each time.
REMEMBERED = 400_000
# Characters of what is remembered at most; text without blanks would otherwise fill the memory with long chunks.
LONGEST = 64
ID_BYTES = 4

# Letters that composition leaves alone and whose lower case is one letter, and marks that
# no contraction or special token begins or ends with.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*&%$#=()\"/+-]*)")


def _splits_at_blanks(settings: dict) -> bool:
    """Whether the tokenizer normalises, drops white space and splits as `Encoder` expects."""
    steps = [n["type"] for n in (settings.get("normalizer") or {}).get("normalizers", [])]
    parts = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = parts[0] if parts else {}
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and [p["type"] for p in parts] == ["Split", "ByteLevel"]
        and split["behavior"] == "Removed"
        and split["invert"]
        and split["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        and not parts[1]["add_prefix_space"]
        and all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in settings["added_tokens"])
        and not any(c.isspace() for t in settings["added_tokens"] for c in t["content"])
    )


@lru_cache(1)
def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level tokenizers write for each byte."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Chunks(dict):
    """Chunk to its ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self._tokenizer, self._model = tokenizer, tokenizer.model
        self._words: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        plain = _PLAIN.fullmatch(chunk)
        if plain:
            ids = self._piece(plain[1].lower()) + (self._piece(plain[2]) if plain[2] else b"")
        else:
            ids = pack(self._tokenizer.encode(chunk, add_special_tokens=False).ids)
        if len(self) < REMEMBERED and len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids

    def _piece(self, text: str) -> bytes:
        known = self._words.get(text)
        if known is None:
            letters = text.encode().decode("latin-1").translate(_byte_letters())
            known = pack([t.id for t in self._model.tokenize(letters)])
            if len(self._words) < REMEMBERED // 2 and len(text) <= LONGEST:
                self._words[text] = known
        return known


def pack(ids: list[int]) -> bytes:
    return b"".join(i.to_bytes(ID_BYTES, "little") for i in ids)


class Encoder:
    """Texts to token ids, packed as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, specials_are_text: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_are_text
        split = _splits_at_blanks(json.loads(self.tokenizer.to_str()))
        self._chunks = _Chunks(self.tokenizer) if split else None

    def packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._chunks is None:
            return pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self._chunks.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(4)
def encoder(path: str, specials_are_text: bool = False) -> Encoder:
    """One encoder for each worker process; what it remembers serves later tasks too."""
    only("encoding")
    remembers("encoding", encoder.cache_clear)
    return Encoder(path, specials_are_text)
