"""Splitting text into the pieces whose merges are independent."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

# The split pattern of the byte-level vocabularies, and the letters and numbers (Unicode L* and N*)
# among the first 592 code points.
GPT_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LATIN_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
LATIN_NUMBERS = "0-9²³¹¼-¾"
#: Texts of these characters alone are split by the standard library, about twice as fast.
latin_only = re.compile("[\t-\r -ɏ]*").fullmatch


def splitter(pattern: str = GPT_SPLIT) -> Callable[[str], list[str]]:
    """A function from a text to the matches of ``pattern`` in it, in order."""
    general = regex.compile(pattern).findall
    if pattern != GPT_SPLIT:
        return general
    latin = re.compile(rf" ?[{LATIN_LETTERS}]+| ?[{LATIN_NUMBERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[^\s{LATIN_LETTERS}{LATIN_NUMBERS}]+|\s+(?!\S)|\s+").findall
    return lambda text: latin(text) if latin_only(text) else general(text)
