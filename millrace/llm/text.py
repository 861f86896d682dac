"""Words and sentences of texts, in one form whatever their writing."""

from __future__ import annotations

import re
import unicodedata

import regex

_TAG = re.compile(r"</?[A-Za-z!?][^<>]*>")
_UNSEEN = regex.compile(r"[\p{M}\p{Cf}\p{Default_Ignorable_Code_Point}--\s]|[\p{Cc}--\s]", regex.V1)
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")


def plain(text: str) -> str:
    """text without accents, compatibility forms, <...> tags and invisible characters, in lower case. None of these divides a word."""
    if text.isascii():
        return _CONTROL.sub("", _TAG.sub("", text) if "<" in text else text).lower()
    text = unicodedata.normalize("NFKD", text)
    text = _UNSEEN.sub("", _TAG.sub("", text) if "<" in text else text)
    return _UNSEEN.sub("", unicodedata.normalize("NFKD", text.casefold()))


def words(text: str) -> list[str]:
    """The runs of letters and digits of text, in the form of plain()."""
    t = plain(text)
    return (_ASCII_WORD if t.isascii() else _WORD).findall(t)
