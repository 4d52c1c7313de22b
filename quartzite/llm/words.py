"""How the public word-end vocabulary cuts a text into words, before its BPE.

Python and the tokenizers library know different versions of Unicode. A text with a code point that this Python has not
assigned (new letters, private planes) is cut by the library's own normaliser and splitter; all others are cut here.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import regex

#: The white space of the vocabulary's patterns (Unicode White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ENDS = "'s|'t|'re|'ve|'m|'ll|'d"
_LATIN = [chr(i) for i in range(0x250)]
_L = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "L")
_N = "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == "N")
#: The same rule for two engines: re is twice as fast, but knows no character properties.
_NARROW = re.compile(f"{_ENDS}|[{_L}]+|[{_N}]|[^{SPACE}{_L}{_N}]+")
_WIDE = regex.compile(rf"{_ENDS}|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
_BEYOND = re.compile("[^\x00-ɏ]")


def normalized(text: str) -> str:
    """NFC, then lower case of each character by itself (so no final sigma)."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ")
    return text.lower()


@functools.lru_cache(maxsize=1)
def _unassigned() -> re.Pattern:
    """Any code point that this Python's Unicode has not assigned."""
    codes = [i for i in range(0x110000) if unicodedata.category(chr(i)) == "Cn"]
    edges = [k for k, i in enumerate(codes) if not k or codes[k - 1] != i - 1]
    return re.compile("[" + "".join(f"{chr(codes[a])}-{chr(codes[b - 1])}" for a, b in zip(edges, [*edges[1:], len(codes)], strict=True)) + "]")


@functools.lru_cache(maxsize=1)
def _library():
    """The library's normaliser and splitter, as the vocabulary's file sets them."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    steps = [normalizers.NFC(), normalizers.Replace(Regex(r"\s+"), " "), normalizers.Lowercase()]
    return normalizers.Sequence(steps), pre_tokenizers.Split(Regex(rf"{_ENDS}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+"), "removed", invert=True)


def words(text: str) -> list[str]:
    """The words of a text without special tokens, in order; white space is dropped."""
    if _BEYOND.search(text) and _unassigned().search(text):
        normaliser, splitter = _library()
        return [w for w, _ in splitter.pre_tokenize_str(normaliser.normalize_str(text))]
    text = normalized(text)
    return (_WIDE if _BEYOND.search(text) else _NARROW).findall(text)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {b: chr(b) for b in keep}, 0x100
    for b in range(256):
        if b not in out:
            out[b], spare = chr(spare), spare + 1
    return [out[b] for b in range(256)]
