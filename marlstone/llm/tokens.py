"""Token ids by the tokenizers library, whole texts, with a bounded cache of pieces.

A text is cut where no token can span (white space); a piece is encoded by the library, or, where punctuation surely
stands by itself, by that of its words; a text's ids are the concatenation of its pieces' ids. Pieces and words share
one cache. Two generations of at most CACHE entries bound its memory.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import sys
from array import array

import numpy as np
import regex
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from .common import KEPT, give_back

#: Entries of a generation that a worker keeps (about 160 bytes each; two generations).
CACHE = 250_000
#: Longer pieces are encoded but not kept.
KEEP_BYTES = 48


def packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Pieces(dict):
    """piece (bytes) -> ids (little-endian unsigned 32-bit); a missing piece is encoded on demand."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(piece)
        if len(piece) <= KEEP_BYTES:
            self[piece] = ids
        return ids

    def trim(self) -> None:
        if len(self) > CACHE:
            self.old = dict(self)
            self.clear()


class WordBpe:
    """Ids of a tokenizers file whose pre-tokenizer drops white space (a JSON text); encode() gives the ids' bytes."""

    def __init__(self, text: str):
        self.whole = Tokenizer.from_str(text)
        self.whole.encode_special_tokens = True  # the strings of special tokens are ordinary text
        self.pieces = Pieces(self._piece)
        spec = json.loads(text)
        split = next((p["pattern"]["Regex"] for p in spec["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split"), None)
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        # only for this chain of steps can a piece be split here; anything else goes through the whole library pipeline
        self.split = regex.compile(split) if split and kinds == ["NFC", "Replace", "Lowercase"] else None
        self.model = self.whole.model
        self.letters = byte_alphabet()
        # characters that NFC and the library's lower-casing treat one by one, as Python does
        self.plain = re.compile(r"[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+\Z")

    def _word(self, word: str) -> bytes:
        """Ids of a lower-case word that the pattern leaves whole."""
        mapped = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
        return packed([t.id for t in self.model.tokenize(mapped)])

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8")
        if self.split and (piece.isascii() and text.isprintable() or self.plain.match(text)):
            text = text.lower()
            if text.isalpha():
                return self._word(text)
            if text[-1] in ".,;:!?" and text[:-1].isalpha():
                return self.pieces[text[:-1].encode()] + self.pieces[piece[-1:]]
            words = self.split.findall(text)
            return self._word(text) if words == [text] else b"".join([self.pieces[w.encode()] for w in words])
        return packed(self.whole.encode(text, add_special_tokens=False).ids)

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, text.split()))

    def trim(self) -> None:
        self.pieces.trim()


class ByteBpe:
    """Byte-level BPE of a rank file through the tokenizers library's BPE model.

    Every pair of tokens whose concatenation has a rank is a merge of that rank, so the model's merges are those of
    the rank file. Text is split by `pattern`; each match is encoded separately.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.letters = byte_alphabet()
        name = {token: "".join(map(self.letters.__getitem__, token)) for token in ranks}
        merges = []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = token[:i], token[i:]
                if a in ranks and b in ranks:
                    merges.append((rank, ranks[a], ranks[b], name[a], name[b]))
        merges.sort()
        model = models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=[(a, b) for *_, a, b in merges], ignore_merges=True)
        self.whole = Tokenizer(model)
        self.whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.model, self.split = model, regex.compile(pattern)
        self.table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.table[rank] = token
        self.sizes = np.array([len(x) for x in self.table], np.int64)
        self.pieces, self.words = Pieces(lambda piece: self._piece(b" " + piece)), {}
        self.tangled = re.compile(r"\s ")

    @classmethod
    def from_file(cls, content: bytes, pattern: str) -> "ByteBpe":
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line.strip())}, pattern)

    def _word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            ids = packed([t.id for t in self.model.tokenize("".join(map(self.letters.__getitem__, word.encode())))])
            if len(word) <= KEEP_BYTES:
                if len(self.words) >= CACHE:
                    self.words.clear()
                self.words[word] = ids
        return ids

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8")
        if piece.isascii() and text[:1] == " ":
            if text[1:].isalpha():
                return self._word(text)
            if text[-1] in ".,;:!?" and text[1:-1].isalpha():
                return self._word(text[:-1]) + self._word(text[-1])
        return b"".join(map(self._word, self.split.findall(text)))

    def encode(self, text: bytes) -> bytes:
        """A space after anything but white space starts a match of its own, so the text may be cut there."""
        if self.tangled.search(text.decode("utf-8")):
            return self._piece(text)
        head, *rest = text.split(b" ")
        return self._piece(head) + b"".join(map(self.pieces.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids; a character split over tokens is whole again as bytes are joined before any decoding."""
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def offsets(self, text: bytes, ids: bytes) -> np.ndarray:
        """(start, end) in code points of every token; a token holding part of a character covers that character."""
        cuts = np.r_[0, np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])]
        lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        upto = np.r_[0, np.cumsum(lead)]  # code points that start before a byte
        inside = np.r_[~lead, False][cuts]  # a cut within a character
        return np.stack([upto[cuts[:-1]] - inside[:-1], upto[cuts[1:]]], 1)

    def trim(self) -> None:
        self.pieces.trim()


def word_bpe(content: str) -> WordBpe:
    """One per worker process and file content."""
    key = "w" + hashlib.sha256(content.encode()).hexdigest()
    if key not in KEPT:
        KEPT[key] = WordBpe(content)
        give_back()
    return KEPT[key]


def byte_bpe(content: bytes, pattern: str) -> ByteBpe:
    key = "b" + hashlib.sha256(content + pattern.encode()).hexdigest()
    if key not in KEPT:
        KEPT[key] = ByteBpe.from_file(content, pattern)
        give_back()
    return KEPT[key]
