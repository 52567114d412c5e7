"""Words of a text as a stemmed index holds them, and texts and pairs as an encoder of questions and passages takes them."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and what stands for them, of the second, third and fourth step of Porter's algorithm (1980).
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
_WORD = re.compile(r"[^\W_]+")
#: Words outside these lengths are left as they are.
LEAST, MOST = 3, 64


def _shape(word: str) -> str:
    """v for a vowel, c for a consonant; y is a vowel after a consonant."""
    out = ""
    for k, letter in enumerate(word):
        out += "v" if letter in "aeiou" or (letter == "y" and k and out[-1] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last of them not w, x or y."""
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _replaced(word: str, suffixes: dict[str, str]) -> str:
    """The longest suffix that fits gives way if what is before it has a measure over 0."""
    for suffix in sorted(suffixes, key=len, reverse=True):
        if word.endswith(suffix):
            root = word[: -len(suffix)]
            return root + suffixes[suffix] if _measure(root) > 0 else word
    return word


def _without_ed_ing(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    root = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s)), None)
    if root is None or "v" not in _shape(root):
        return word
    if root.endswith(("at", "bl", "iz")):
        return root + "e"
    if len(root) > 1 and root[-1] == root[-2] and _shape(root)[-1] == "c" and root[-1] not in "lsz":
        return root[:-1]
    return root + "e" if _measure(root) == 1 and _short(root) else root


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if not LEAST <= len(word) <= MOST:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    word = _without_ed_ing(word)
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, SECOND), THIRD)
    for suffix in sorted(FOURTH, key=len, reverse=True):
        if word.endswith(suffix):
            root = word[: -len(suffix)]
            if _measure(root) > 1 and (suffix != "ion" or root.endswith(("s", "t"))):
                word = root
            break
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def plain(text: str | None) -> str:
    """Lower-cased, without the marks that letters carry."""
    return "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))


def stems(text: str | None) -> list[str]:
    """The stems of all words of a text, in order; null has none."""
    return [stem(w) for w in _WORD.findall(plain(text))]


def stemmed_words(text: Column) -> Column:
    """array<string> of stems; in Arrow batches, as no built-in function stems."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(stems, na_action=None)

    return run(text)


def _own_word(c: str) -> bool:
    """Punctuation of any kind, all ASCII symbols among it, and CJK ideographs."""
    k = ord(c)
    return (33 <= k <= 126 and not c.isalnum()) or unicodedata.category(c).startswith("P") or 0x4E00 <= k <= 0x9FFF or 0x3400 <= k <= 0x4DBF or 0x20000 <= k <= 0x2CEAF or 0xF900 <= k <= 0xFAFF or 0x2F800 <= k <= 0x2FA1F


def encoder_words(text: str | None) -> list[str]:
    """Words of a text for an uncased encoder: no control characters, no marks on letters, punctuation and ideographs each alone."""
    kept = (" " if c in "\t\n\r" or unicodedata.category(c) == "Zs" else c for c in text or "" if c in "\t\n\r" or not (c in "\0�" or unicodedata.category(c).startswith("C")))
    return "".join(f" {c} " if _own_word(c) else c for c in plain("".join(kept))).split()


def pair_ids(question: Column, passage: Column, first: int, between: int, most: int = 512) -> Column:
    """struct(ids, types): first, question, between, passage, between. Only the passage is cut; a question without room is an error."""
    room = F.lit(most - 3) - F.size(question)
    kept = F.slice(passage, 1, F.when(room < 0, F.raise_error(F.lit("the question leaves no room")).cast("int")).otherwise(room))
    head, tail = F.concat(F.array(F.lit(first)), question, F.array(F.lit(between))), F.concat(kept, F.array(F.lit(between)))
    types = F.concat(F.array_repeat(F.lit(0), F.size(head)), F.array_repeat(F.lit(1), F.size(tail)))
    return F.struct(F.concat(head, tail).alias("ids"), types.alias("types"))
