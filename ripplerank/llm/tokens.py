"""Token ids of whole texts, by the tokenizers library."""

from __future__ import annotations

import functools
import os
import re
import struct
from collections.abc import Callable

#: Entries that a worker keeps of words and of pieces of words. The caches hold results only: what a full one lacks is worked out each time.
WORDS, PIECES = 500_000, 750_000

_PLAIN = re.compile(rb"[!-&(-;=-~\xc3\x80-\xbf]+")  # bytes of ASCII without ' and <, and of two-byte letters that begin with \xc3
_ASCII = re.compile(rb"[!-&(-;=-~]+")
_PACK = [struct.Struct(f"<{n}I").pack for n in range(64)]  # by the number of ids
_SPLIT = re.compile(r"[^\W\d_]+|\d|(?:[^\w]|_)+")


def default_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed package of public tokenizers has a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Texts that tell whether a vocabulary drops white space between words: what stands around a word must not change its ids.
_PROBES = ["the cat sat", " the  cat\tsat\n", "\n\nThe cat's 12 hats.\r\n", "don't  stop -- 3,14 x", "a\x0bb\x0cc", "Über die Straße"]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, equal to Tokenizer.encode(text, add_special_tokens=False).

    A vocabulary that drops white space before its merges gives the ids of a text as those of its words, one after the other; words are looked up in a cache, and only new ones
    reach the library. The vocabulary's own answers to _PROBES say at load whether it is of this kind; with any other whole texts go to the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = all(self.whole(x) == b"".join(map(self.whole, x.split())) for x in _PROBES)
        self.pieces, self.words = _Kept(self.short, PIECES), _Kept(self.word, WORDS)
        self.model, level = self.tokenizer.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(33, 256) if c < 127 or c > 160}  # bytes as the vocabulary writes them
        self.plain = self.by_word and all(self.short(x) == self.whole(x) == self.whole(x.upper()) for x in ("the", "thndhain", "çüßñé".replace("ß", "s"), "7", "$$$", "..."))

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def short(self, text: str) -> bytes:
        """Ids of one piece straight from the model, past the parts of the library that cut texts."""
        ids = [t.id for t in self.model.tokenize(text if text.isascii() else text.translate(self.signs))]
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: bytes) -> bytes:
        """Plain words are cut as the vocabulary's pattern cuts them: runs of letters, single digits, runs of other signs. Letters of ASCII, with one sign behind them or none, are most words and take a short way to the same."""
        if self.plain:
            low = word.lower()
            if low.isalpha():
                return self.pieces[low.decode()]
            if low[-1] in b".," and low[:-1].isalpha():
                return self.pieces[low[:-1].decode()] + self.pieces[low[-1:].decode()]
        if self.plain and (_ASCII if word.isascii() else _PLAIN).fullmatch(word):
            text = word.decode().lower()
            core = text.rstrip(".,")
            if core.isalpha():
                return self.pieces[core] if len(core) == len(text) else self.pieces[core] + self.pieces[text[len(core) :]]
            if "×" not in text and "÷" not in text:
                return b"".join(map(self.pieces.__getitem__, _SPLIT.findall(text)))
        return self.whole(word.decode("utf-8"))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, text.encode("utf-8").split()))


class _Kept(dict):
    """A function's results, up to a number of short keys."""

    def __init__(self, of: Callable, most: int):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, key):
        found = self.of(key)
        if self.most and len(key) <= 64:
            self[key] = found
            self.most -= 1
        return found


@functools.lru_cache(2)
def encoder(path: str | None = None) -> Encoder:
    """One encoder in a worker."""
    return Encoder(path or default_path())
