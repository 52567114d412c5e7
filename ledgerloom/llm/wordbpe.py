"""Exact encoding for tokenizers whose BPE marks the end of each word.

The vocabulary file is a `tokenizers` JSON: NFC, white space to one space, lower case, split into
letter runs, digits and symbol runs, byte-level BPE with an end-of-word suffix. No match of the
split pattern holds white space and no normalisation step reaches across it, so a text encodes as
the concatenation of its words, a word being a run between ASCII white space. Plain words are split
here and merged by tiktoken's merge loop, with a zero byte (never in a plain word) as the end mark.
Words with characters outside the Latin blocks, with special-token text or with other white space
or control characters inside go through `tokenizers` itself.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

_SUFFIX, _END = "</w>", "\x00"
_LETTERS, _DIGITS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾", " \t\n\r\x0b\x0c"
_PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+").findall
#: Printable ASCII and the Latin blocks to U+017F, without the letter whose lower case is two characters.
_PLAIN = re.compile("[\t-\r\x20-\x7e¡-įı-ſ]*").fullmatch


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_alphabet() -> dict[str, int]:
    """The byte of each printable stand-in in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordBpe:
    """`encode` gives ids as native unsigned 32-bit bytes; `tokens[i]` is the text of id i."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.reference = Tokenizer.from_file(path)
        self.reference.no_truncation()
        self.reference.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = spec["model"]["vocab"]
        alphabet = _byte_alphabet()
        ranks = {}
        self.tokens = [""] * (max(*vocabulary.values(), *special.values()) + 1)
        for text, i in (vocabulary | special).items():
            self.tokens[i] = text
            if text not in special:
                body = text.removesuffix(_SUFFIX)
                ranks[bytes(alphabet[c] for c in body) + _END.encode() * (body != text)] = i
        self._core = tiktoken.Encoding("words", pat_str="[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def _plain(self, text: str) -> bytes:
        pieces = _PIECES(text.lower())
        return bytes(self._core.encode_to_tiktoken_buffer(_END.join(pieces) + _END, set())) if pieces else b""

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text, as the tokenizers library gives them without special tokens added."""
        s = text.decode("utf-8")
        if "<|" not in s and _PLAIN(s):
            return self._plain(s)
        out, plain = [], []
        for word in text.split():  # at ASCII white space only
            w = word.decode("utf-8")
            if "<|" not in w and _PLAIN(w):
                plain.append(w)
                continue
            if plain:
                out.append(self._plain(" ".join(plain)))
                plain = []
            out.append(np.array(self.reference.encode(w, add_special_tokens=False).ids, np.uint32).tobytes())
        if plain:
            out.append(self._plain(" ".join(plain)))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, np.uint32).tolist()))


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """One instance for each vocabulary and Python worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


class Bounded(dict):
    """A cache of at most `limit` entries, in two generations: what is not used for a while goes."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.half, self.old = make, max(1, limit // 2), {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
