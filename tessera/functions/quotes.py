"""Quotes and citation markers in answers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shorter quotes prove nothing.
LEAST = 12
#: Invisible and direction marks; variants of apostrophes, quotation marks and dashes.
_INVISIBLE = re.compile("[​-‏‪-‮⁦-⁩⁠﻿­؜]")
_VARIANTS = ((re.compile("[‘’ʼ`´]"), "'"), (re.compile("[“”«»„]"), '"'), (re.compile("[‐-―−]"), "-"), (re.compile("…"), "..."))


def plain(text: str) -> str:
    """A form in which equal wordings are equal strings: NFKC, one form of marks, single spaces, lower case."""
    text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    for pattern, mark in _VARIANTS:
        text = pattern.sub(mark, text)
    return " ".join(text.split()).lower()


def verified(text: Column, quote: Column) -> Column:
    """Whether the quote stands in the text word for word. NFKC isn't built in, so this is a pandas function."""

    @F.pandas_udf("boolean")
    def contains(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, quotes in parts:
            yield pd.Series([bool(q) and len(p := plain(q)) >= LEAST and p in plain(t or "") for t, q in zip(texts, quotes)])

    return contains(text, quote)


def markers(answer: Column) -> Column:
    """Numbers of the citation markers [c1], [c2] ... in the order of their first place."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[c(\d+)\]"), F.lit(1)), lambda x: x.cast("int")))


def sentences(answer: Column) -> Column:
    return F.filter(F.split(F.trim(answer), r"(?<=[.!?])\s+"), lambda s: s != "")


def uncited_sentences(answer: Column) -> Column:
    """How many sentences have no marker."""
    return F.size(F.filter(sentences(answer), lambda s: ~s.rlike(r"\[c\d+\]")))
