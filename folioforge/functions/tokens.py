"""Tokens. Compatibility forms and case folding are defined over all of Unicode, which the JVM's functions do
not offer, so texts go through Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_BEYOND = re.compile(r"[^\x00-\x7f]+")


def words(text: str | None) -> list[str]:
    """Words of the compatibility form, case folded: of queries, titles and gates."""
    return _WORD.findall(unicodedata.normalize("NFKC", text or "").casefold())


def without_marks(text: str) -> str:
    if text.isascii():
        return text
    return _BEYOND.sub(lambda m: "".join(c for c in m[0] if not unicodedata.combining(c)), unicodedata.normalize("NFD", text))


def indexed_words(text: str | None) -> list[str]:
    """Words as the full-text index holds them: lower case, without diacritics."""
    return _WORD.findall(without_marks((text or "").lower()))


def _words(texts: pd.Series) -> pd.Series:
    return texts.map(words)


def tokens(c: Column) -> Column:
    """Words of a text column; null is empty."""
    return F.pandas_udf(_words, "array<string>")(c)


def truncated_to_tokens(c: Column, most: int, vocabulary_path: str) -> Column:
    """A text cut to its first ``most`` tokens of a vocabulary (the tokenizers library's JSON, wherever it lies on the
    executors); shorter texts stay as they are, null stays null."""

    def cut(texts: pd.Series) -> pd.Series:
        vocabulary = _vocabulary(vocabulary_path)

        def one(text: str | None) -> str | None:
            if text is None or len(text) <= most:  # a token is a character at least, but for bytes of one
                found = None if text is None or text.isascii() else vocabulary.encode(text, add_special_tokens=False)
            else:
                found = vocabulary.encode(text, add_special_tokens=False)
            return text if found is None or len(found.ids) <= most else text[: found.offsets[most - 1][1]]

        return texts.map(one)

    return F.pandas_udf(cut, "string")(c)


@cache
def _vocabulary(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
