"""Token ids of whole texts as the tokenizers library gives them, with a bounded memo of words.

The library spends most of its time on words it has met before. Both kinds of
vocabulary handled here cut a text into words by a pattern before any merge, so
the ids of a text are the ids of its words in order, and a memo of words may stand
for the library. The memo serves only texts for which the cut is easy to state:
texts of Latin-1 characters without any special token's string. All others go to
the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array

LATIN = [chr(c) for c in range(256)]
LETTERS = "".join(c for c in LATIN if c.isalpha())
NUMBERS = "".join(c for c in LATIN if c.isnumeric())
SPACES = "\t-\r \x85\xa0"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The patterns by which the two kinds of vocabulary cut texts, for Latin-1 characters.
WORD_PATTERN = f"{CONTRACTIONS}|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+"
BYTE_PATTERN = f"{CONTRACTIONS}| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: As the vocabulary files state these patterns.
WORD_REGEX = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

ODD_SPACE = re.compile("  | \n|\n |\n\n|[\t\x0b-\r\x85\xa0]").search


def byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


#: Longer words are worked out each time, so that the number of words bounds the memo's bytes.
LONGEST = 64


class Memo(dict):
    """word -> ids as bytes of unsigned 32-bit integers; words not yet known are worked out."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, word: str) -> bytes:
        ids = self.find(word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids


class Encoder:
    """Ids of texts by the vocabulary file at ``path``, a tokenizers JSON file."""

    def __init__(self, path: str, memo_words: int = 800_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.memo_words = memo_words
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        self.special = [x["content"] for x in stated["added_tokens"]]
        self.kind = self.kind_of(stated)
        self.table = byte_characters()
        self.parts = Memo(self.part_ids)
        pattern = {"word": WORD_PATTERN, "byte": BYTE_PATTERN}.get(self.kind)
        self.cut = re.compile(pattern).findall if pattern else None
        self.inner = Memo(self.word_ids)
        self.first = Memo(self.word_ids)

    @staticmethod
    def kind_of(stated: dict) -> str:
        """"word" and "byte" are the two kinds whose words are known; "" is any other, for which the library does all."""
        pre, norm, model = stated["pre_tokenizer"] or {}, stated["normalizer"], stated["model"]
        plain = not any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in stated["added_tokens"]) and not stated.get("post_processor") and model["type"] == "BPE" and not model.get("dropout") and not model.get("ignore_merges")
        if plain and norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
            return "byte"
        steps = pre.get("pretokenizers", [{}])
        kinds = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        if plain and kinds == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": WORD_REGEX}:
            return "word"
        return ""

    def part_ids(self, part: str) -> bytes:
        """Ids of one word as the pattern cuts it."""
        table = self.table
        return array("I", [t.id for t in self.model.tokenize("".join([table[b] for b in part.encode()]))]).tobytes()

    def word_ids(self, piece: str) -> bytes:
        """Ids of a run of text between spaces."""
        return b"".join(map(self.parts.__getitem__, self.cut(piece)))

    def library_ids(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Ids of the whole text, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut is None or not self.plain(text):
            return self.library_ids(text)
        if len(self.inner) + len(self.first) > self.memo_words or len(self.parts) > self.memo_words:
            self.inner.clear()
            self.first.clear()
            self.parts.clear()
        if self.kind == "word":
            return b"".join(map(self.inner.__getitem__, text.lower().replace("\n", " ").split(" ")))
        if ODD_SPACE(text):
            return b"".join(map(self.parts.__getitem__, self.cut(text)))
        return self.byte_ids(text)

    def byte_ids(self, text: str) -> bytes:
        """No two spaces or line breaks stand side by side: each space belongs to the word after it, each break is a word."""
        first, inner, pieces = self.first, self.inner, []
        for k, line in enumerate(text.split("\n")):
            if k:
                pieces.append(first["\n"])
            head, *rest = line.split(" ")
            pieces.append(first[head])
            pieces += map(inner.__getitem__, [" " + x for x in rest])
        return b"".join(pieces)

    def plain(self, text: str) -> bool:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return False
        return not any(s in text for s in self.special)


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, memo_words: int = 800_000) -> Encoder:
    """The encoder of this Python process for ``path``; worker processes are reused, and the memo with them."""
    key = (path, memo_words)
    if key not in _encoders:
        _encoders[key] = Encoder(path, memo_words)
    return _encoders[key]


def vocabulary(name: str) -> str:
    """The place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)
