"""The word-level byte-pair vocabulary: splitting texts into words, and what both of its users need of the file.

Normalisation: NFC, runs of white space to one blank, lower case. Words: a contraction's end, a run of letters, one
digit, or a run of anything else but white space. A word's symbols are its UTF-8 bytes, the last one marked as the end.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Fixed values of the file format: special strings, the end mark, the white space of its patterns in Latin-1.
SPECIALS = ("<|startoftext|>", "<|endoftext|>")
END_OF_WORD = "</w>"
_SPACE = r"\t-\r \x85\xa0"

_LATIN = r"a-zA-Zªµº\xc0-\xd6\xd8-\xf6\xf8-ſ"
_NUMBER = r"0-9²³¹¼½¾"
_plain_words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[{_NUMBER}]|[^{_SPACE}{_LATIN}{_NUMBER}]+").findall
_any_words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+").findall
_not_plain = re.compile("[^\x00-įı-ŷŹ-ſ‐-‧€]").search
_special = re.compile("|".join(map(re.escape, SPECIALS)))


def is_plain(text: str) -> bool:
    """No character on which Unicode versions or normal forms could differ."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")  # much faster than a search
        return True
    except UnicodeEncodeError:
        return not _not_plain(text)


def has_special(text: str) -> bool:
    return "<|" in text and _special.search(text) is not None


def parts(text: str) -> list[str]:
    """The text between special strings; one more part than there are special strings."""
    return _special.split(text) if "<|" in text else [text]


def split_words(text: str) -> list[str]:
    if is_plain(text):
        return _plain_words(text.lower())
    return _any_words("".join(map(str.lower, unicodedata.normalize("NFC", text))))


def merge_ranks(path: str) -> dict[tuple[str, str], int]:
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    return {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): k for k, m in enumerate(merges)}


class Chunks:
    """Plain texts cut at ASCII blanks, which no word spans, with every distinct chunk of a batch looked at once.

    Arrow cuts the texts and numbers the chunks, so Python sees a batch's distinct chunks instead of all its words. What
    a chunk is worth (its ids, its number of tokens) stays known for the first `remembered` chunks; frequent ones are
    among them. worth: from a list of lists of words to a value for each.
    """

    def __init__(self, worth, remembered: int):
        self.worth, self.most, self.known = worth, remembered, {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, pa.Array, list]:
        """Where each text's chunks begin and end in the batch's, each chunk's number, and the numbered chunks' values."""
        lists = pc.ascii_split_whitespace(pa.array([t.lower() for t in texts], pa.string()))
        coded = lists.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        values = list(map(self.known.get, names))
        at = [k for k, v in enumerate(values) if v is None]
        for k, v in zip(at, self.worth([_plain_words(names[k]) for k in at]), strict=True):
            values[k] = v
            if len(self.known) < self.most:
                self.known[names[k]] = v
        return lists.offsets.to_numpy(), coded.indices, values
