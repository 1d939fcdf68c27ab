"""Token ids of whole texts by a public byte-level tokenizer file, quickly and in bounded memory."""

from __future__ import annotations

import json
import os
import re
from array import array

#: What a file says whose texts may be cut so: no normalizer, the byte-level pattern, merges that nothing changes.
_CUT = {
    "normalizer": None,
    "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True},
    "model": {
        "type": "BPE", "dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None,
        "byte_fallback": False, "ignore_merges": False,
    },
}
#: Texts of these characters alone are cut by the pattern below exactly as the tokenizer cuts
#: texts before its merges; all other texts are encoded whole.
_KNOWN = re.compile(r"[\n\x20-\x7E\xC0-\xD6\xD8-\xF6\xF8-\xFF]*")
_PIECES = re.compile(
    r" ?[A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+"
    r"| ?[^\sA-Za-z0-9\xC0-\xD6\xD8-\xF6\xF8-\xFF]+|\s+(?!\S)|\s+"
)
#: Pieces remembered at once, and the longest of them.
_REMEMBERED, _LONGEST = 800_000, 40
_HELD: dict = {}


def _says(found, wanted) -> bool:
    """Whether what a file says has all that is wanted; a name it leaves out counts as null or false."""
    if isinstance(wanted, dict):
        return isinstance(found, dict) and all(_says(found.get(k), v) for k, v in wanted.items())
    return found == wanted or (found is None and wanted is False)


class Encoder:
    """Ids as native unsigned 32-bit little-endian bytes, from the tokenizers library.

    Texts repeat their words, so the ids of each piece are remembered, up to a bound. Special
    strings of the file are matched in texts, as the library does unless told otherwise. Of
    files with another way to cut texts, all texts are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            self.cuts = _says(json.load(file), _CUT)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merges = self.tokenizer.model
        plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
        others = [b for b in range(256) if b not in plain]
        self.shown = {b: chr(256 + i) for i, b in enumerate(others)}  # how byte-level files spell bytes
        self.known: dict[str, bytes] = {}

    def _merged(self, piece: str) -> bytes:
        if piece.isascii() and piece.lstrip(" ").isalnum():
            spelled = piece.replace(" ", "\u0120")
        else:
            spelled = piece.encode().decode("latin-1").translate(self.shown)
        return array("I", [t.id for t in self.merges.tokenize(spelled)]).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.cuts or not _KNOWN.fullmatch(text) or any(s in text for s in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        pieces = _PIECES.findall(text)
        ids = [*map(self.known.get, pieces)]
        if None in ids:
            new = {p: self._merged(p) for p in {p for p, i in zip(pieces, ids) if i is None}}
            ids = [new[p] if i is None else i for p, i in zip(pieces, ids)]
            if len(self.known) + len(new) > _REMEMBERED:
                self.known.clear()
            self.known.update((p, i) for p, i in new.items() if len(p) <= _LONGEST)
        return b"".join(ids)


def encoder(path: str) -> Encoder:
    """The encoder of a file, one per Python worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _HELD:
        _HELD[path] = Encoder(path)
    return _HELD[path]
