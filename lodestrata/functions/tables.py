"""Parsers as table functions, for use from SQL: ``FROM sources, LATERAL parse_routines(text)``."""

from __future__ import annotations

from collections.abc import Iterator

import regex
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.routines import ROUTINE_SCHEMA, TOKENS, WORDS, routines_of

_KINDS = [(kind, regex.compile(pattern.replace(r"\z", r"\Z"))) for kind, pattern in TOKENS]
_EVERY = regex.compile("|".join(f"(?P<{kind}>{pattern.replace(r'\z', r'\Z')})" for kind, pattern in TOKENS))
_WORDS = {w: kind for kind, words in reversed(WORDS) for w in words.split()}


def tokens_of(text: str) -> Iterator[tuple[int, str, str]]:
    """``(position, kind, token)`` of every token, as ``routines.tokens`` finds them."""
    for i, found in enumerate(_EVERY.finditer(text)):
        token, kind = found[0], found.lastgroup
        if kind == "bad_character":  # a quote that opens nothing is a string when it stands alone
            kind = next(k for k, p in _KINDS if p.fullmatch(token))
        yield i, _WORDS.get(token.lower(), "name") if kind == "word" else "keyword" if kind == "phrase" else kind, token


class ParseRoutines:
    """Rows of ``routines.routines`` for one text; ``editor`` reads the editors' dialect. A null text has none."""

    def eval(self, text: str, editor: bool = False) -> Iterator[tuple]:
        for r in routines_of(text or "", bool(editor)):
            yield r["name"], r["access"], r["return_type"], r["is_event"], r["arguments"], r["script"], r["line_start"], r["line_end"]


class Tokenize:
    """Rows of ``routines.tokens`` for one text. A null text has none."""

    def eval(self, text: str) -> Iterator[tuple]:
        yield from tokens_of(text or "")


def register(spark: SparkSession) -> None:
    """``parse_routines(text [, editor])`` and ``tokenize(text)``.

    Rows go to Python and back in pickled batches: with Arrow every row of the
    outer table would be a table of its own, which costs far more than parsing.
    """
    spark.udtf.register("parse_routines", F.udtf(ParseRoutines, returnType=ROUTINE_SCHEMA, useArrow=False))
    spark.udtf.register("tokenize", F.udtf(Tokenize, returnType="position int, kind string, token string", useArrow=False))
