"""Token ids of whole texts by a tokenizers file, with a memo of words."""

from __future__ import annotations

import json
import re
from array import array
from itertools import chain

#: Pieces of words remembered by a worker; beyond that it starts anew, which costs time and changes no result.
MEMO_WORDS = 800_000
_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a file; workers live on from task to task."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _byte_signs() -> dict[int, str]:
    """The printable sign of each byte in byte-level vocabularies: itself if printable, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(0x100 + i) for i, b in enumerate(others)}


_BYTE_SIGNS = _byte_signs()


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def largest_id(path: str) -> int:
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)


# The pattern of word_bpe_49k.json, and what it amounts to below U+0250 after lower-casing, for the faster module re.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿĀ-ɏ", "0-9²³¹¼-¾"
_LATIN_CUT = rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+"


class WordEncoder(dict):
    """Encodes texts with a byte-level tokenizer that drops white space, so that each piece of a word is encoded by itself, once.

    Texts that in lower case are of Latin letters and signs below U+0250 are cut with the file's own pattern; words of other texts are
    normalised and cut by the tokenizer.
    Texts that hold an added token, or one of the separators 0x1C to 0x1F (white space to Python only), are encoded whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.whole = re.compile("|".join([re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()] + ["[\x1c-\x1f]"])).search
        steps = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"]
        pattern = steps[0]["pattern"]["Regex"]
        self.cut = (re.compile(_LATIN_CUT) if pattern == _CUT else regex.compile(pattern)).findall
        self.latin = re.compile("[\t-\r -~\x85\xa0-\u024f]*").fullmatch
        self.words: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMO_WORDS:
            self.clear()
        signs = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_SIGNS)
        ids = array("I", [x.id for x in self.tokenizer.model.tokenize(signs)]).tobytes()
        if len(piece) < 100:
            self[piece] = ids
        return ids

    def word(self, word: str) -> bytes:
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= MEMO_WORDS // 4:
                self.words.clear()
            ids = self.words[word] = self.entire(word)
        return ids

    def entire(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as native (little-endian) unsigned 32-bit integers."""
        low = text.lower()
        if self.latin(low) and not ("<|" in text and self.whole(text)):
            return b"".join(map(self.__getitem__, self.cut(low)))
        if self.whole(text):
            return self.entire(text)
        return b"".join(map(self.word, text.split()))
