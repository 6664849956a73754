"""Column functions over source text: lines, sizes, names, hashes, complexity."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """The lines of a text; a break at its very end opens no further line, and an empty text has none."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def with_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A row per line, with ``line_no`` from 1 and ``line``, instead of the text. Null texts have no lines."""
    others = [c for c in df.columns if c != text_col]
    return df.select(*others, F.posexplode(lines(F.col(text_col))).alias("pos", "line")).select(*others, (F.col("pos") + 1).alias("line_no"), "line")


def line_count_breaks(text: Column) -> Column:
    """Number of line breaks."""
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))


def indent_width(line: Column) -> Column:
    """Bytes of white space in front."""
    return F.octet_length(line) - F.octet_length(F.regexp_replace(line, r"^\s+", ""))


def human_size(n: Column) -> Column:
    """Bytes as B, KB or MB, the latter two with one decimal."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024.0), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", n / 1048576.0), F.lit(" MB")))


def epoch_text(seconds: Column, milliseconds_after: int | None = 3_000_000_000) -> Column:
    """Epoch seconds in UTC as ``yyyy-MM-dd HH:mm:ss``; later stamps than ``milliseconds_after`` are milliseconds, with None no stamps are. Years beyond 9999 have no sign. Whole numbers are exact; doubles are cut to microseconds after they are multiplied."""
    whole = seconds if milliseconds_after is None else F.when(seconds > milliseconds_after, F.floor(seconds / 1000)).otherwise(seconds)
    return F.regexp_replace(F.date_format(F.timestamp_seconds(whole), "yyyy-MM-dd HH:mm:ss"), r"^\+", "")


def base_name(name: Column) -> Column:
    """Without the extension; a leading dot starts no extension."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def extension(name: Column) -> Column:
    """Lower-case extension with its dot, or nothing."""
    return F.lower(F.regexp_extract(name, r".(\.[^.]*)\z", 1))


def class_name(name: Column) -> Column:
    """``w_order_list`` as ``WOrderList``."""
    return F.replace(F.initcap(F.replace(base_name(name), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))


def kebab_name(name: Column) -> Column:
    """``w_order_list`` as ``w-order-list``."""
    return F.lower(F.replace(base_name(name), F.lit("_"), F.lit("-")))


def content_hash(text: Column) -> Column:
    """SHA-256 of the UTF-8 text, in hex."""
    return F.sha2(text.cast("binary"), 256)


# Seed and multiplier of the index's checksum: fixed values.
CHECKSUM_SEED, CHECKSUM_FACTOR = 2166136261, 16777619


def checksum(text: Column) -> Column:
    """The index's 64-bit checksum of a text, in hex: the sum so far times the factor, then exclusive-or with the next byte.

    Multiplication has to wrap around, which SQL numbers do not, so bytes are
    folded in Arrow batches. For new indexes ``xxhash64`` costs far less.
    """

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            h = CHECKSUM_SEED
            for b in t.encode():
                h = h * CHECKSUM_FACTOR & 0xFFFFFFFFFFFFFFFF ^ b
            return f"{h:016x}"

        return texts.map(one)

    return fold(text)


def pick(json_text: Column, key: str) -> Column:
    """The value of a key of a JSON object as text."""
    return F.get_json_object(json_text, f"$.{key}")


def emit(**values: Column) -> Column:
    """A JSON object of columns; null values are left out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in values.items()]))


#: Escapes of strings in report objects, in the order they are undone: fixed values of the format.
STRING_ESCAPES = (("~n", "\n"), ("~r", "\r"), ("~t", "\t"), ('~"', '"'), ("~~", "~"))


def decode_string(text: Column) -> Column:
    """Undo the escapes, one kind after the other."""
    for escape, plain in STRING_ESCAPES:
        text = F.replace(text, F.lit(escape), F.lit(plain))
    return text


def encode_string(text: Column) -> Column:
    """Escape a string so that :func:`decode_string` gives it back unless a tilde comes before n, r or t."""
    for escape, plain in reversed(STRING_ESCAPES):
        text = F.replace(text, F.lit(plain), F.lit(escape))
    return text


# -- complexity ---------------------------------------------------------------

# Keywords of the language: fixed values. Lines of a routine that start with one of these branch.
BRANCHES = ("if", "else", "elseif", "choose case", "case", "for", "do while", "do until", "continue", "exit", "return", "throw", "goto")
# The faster count takes a line once if any of these words is in it (short ones) or starts it (long ones).
SHORT_KEYWORDS = ("if", "else", "for", "next", "do", "loop", "case", "try", "exit", "and", "or")
LONG_KEYWORDS = ("elseif", "end if", "while", "choose", "catch", "finally", "continue", "return")
# Starts of lines that open and close a block; those that end in a blank go on behind it.
OPENING = ("if ", "if(", "for ", "for(", "do ", "choose case", "try")
CLOSING = ("end if", "end for", "end do", "next", "end choose", "end try", "loop")

#: White space at the ends of a line: what tools indent by, and what other platforms leave behind.
WHITE = " \t\r\n\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u3000"
# The measures below go over a script as a whole, a line being what starts at ^ and ends at a line feed.
_GAP = r"[ \t\r\x0B\f\x1C-\x1F\x85\xA0\u3000]"
_LINE = rf"(?dim)^{_GAP}*+"


def stripped(line: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.trim(line, F.lit(WHITE))


def _words(words: tuple[str, ...], gap: str = _GAP + "+") -> str:
    return "|".join(w.replace(" ", gap) for w in words)


def code_lines(script: Column) -> Column:
    """Number of lines that are neither empty nor comments."""
    return F.regexp_count(script, F.lit(_LINE + r"(?!//|')[^\n]"))


def complexity(script: Column) -> Column:
    """Cyclomatic complexity of a routine: 1, and 1 for each branching line, the cases of a choice counting once."""
    branches = F.regexp_count(script, F.lit(rf"{_LINE}(?:{_words(BRANCHES)})\b"))
    cases = F.regexp_count(script, F.lit(rf"{_LINE}case (?=[^\n]*\S)"))
    return F.lit(1) + branches - cases + F.when(cases > 0, 1).otherwise(0)


def quick_complexity(script: Column) -> Column:
    """A coarser count: 1, and 1 for each line with a keyword outside its ``//`` comment."""
    started, inside = rf"{_GAP}*+(?:{_words(LONG_KEYWORDS, ' ')})", rf"(?:(?!//)[^\n])*?\b(?:{_words(SHORT_KEYWORDS)})\b"
    return F.lit(1) + F.regexp_count(script, F.lit(rf"(?dim)^(?:{started}|{inside})"))


def rating(cc: Column) -> Column:
    """A to F by complexity."""
    return F.when(cc <= 5, "A").when(cc <= 10, "B").when(cc <= 20, "C").when(cc <= 50, "D").otherwise("F")


def depth(steps: Column) -> Column:
    """Deepest level that an array of +1 and -1 steps reaches, never going below 0."""
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("m"))
    walk = F.aggregate(steps, start, lambda acc, x: F.struct(F.greatest(acc["d"] + x, F.lit(0)).alias("d"), F.greatest(acc["m"], acc["d"] + x).alias("m")))
    return walk["m"]


def max_nesting(script: Column) -> Column:
    """Deepest nesting of blocks in a routine."""
    starts = "|".join(re.escape(w) + (r"(?=[^\n]*\S)" if w.endswith(" ") else "") for w in OPENING + CLOSING)
    steps = F.regexp_extract_all(script, F.lit(f"{_LINE}({starts})"), 1)
    return depth(F.transform(steps, lambda x: F.when(F.lower(x).isin(*CLOSING), -1).otherwise(1)))


#: Numbers that explain themselves: fixed values.
PLAIN_NUMBERS = (0, 1, 2, 4, 8, 10, 16, 32, 64, 100, 128, 256, 512, 1000, 1024, 2048, 8192)


def magic_numbers(script: Column, most: int = 10) -> Column:
    """Distinct whole numbers between 2 and 100000 that a routine does not explain, in order; none after ``//`` or a quote."""
    found = F.filter(F.regexp_extract_all(script, F.lit(r"(?://|')[^\n]*|(?<![.\w])(\d{1,18})(?![.\w])"), 1), lambda x: x != "")
    numbers = F.transform(found, lambda x: x.cast("long"))
    kept = F.filter(numbers, lambda x: ~x.isin(*PLAIN_NUMBERS) & (x > 2) & (x < 100000))
    return F.slice(F.array_distinct(F.transform(kept, lambda x: x.cast("string"))), 1, most)
