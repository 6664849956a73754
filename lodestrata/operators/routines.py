"""Routines, variables and tokens of source texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import WHITE, code_lines, complexity, max_nesting, rating, stripped

ROUTINE_SCHEMA = "name string, access string, return_type string, is_event boolean, arguments array<string>, script string, line_start int, line_end int"
_ROUTINE_ARROW = pa.schema([("name", pa.string()), ("access", pa.string()), ("return_type", pa.string()), ("is_event", pa.bool_()), ("arguments", pa.list_(pa.string())), ("script", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32())])
# Words of declarations: fixed forms of the language.
ROUTINE_ACCESS = ("public", "protected", "private", "global")
ROUTINE_KINDS = ("subroutine", "function")
EVENT_KINDS = ("event", "on")
# Words that a variable's declaration begins with, and second words of other declarations.
ACCESS = ("public", "protected", "private", "instance", "shared", "global")
NO_DATA_TYPES = ("subroutine", "function", "type")


def _leading(word: str, also: str = "") -> str:
    """The letters, digits and underscores that a word begins with."""
    return re.match(rf"[\w{also}]*", word)[0]


def declared(line: str, editor: bool = False) -> dict | None:
    """The routine that a line declares, read word by word: what stands before the parenthesis, and the arguments inside."""
    head, _, rest = line.partition("(")
    words = head.split()
    low = [w.lower() for w in words[:3]]
    arguments = [a.strip() for a in rest.partition(")")[0].split(",")] if ")" in rest else []
    found = {"access": "public", "return_type": None, "arguments": [a for a in arguments if a]}
    if low and low[0] in EVENT_KINDS and len(words) > 1:
        name = _leading(words[1], ".")
        if not name or editor and (low[0] != "on" or not all(name.partition(".")[::2])):
            return None
        return found | {"name": name, "is_event": True}
    at = 1 if low[:1] == ["forward"] else 0
    if low[at : at + 1] and low[at] in ROUTINE_ACCESS:
        found["access"], at = low[at], at + 1
    elif at or not editor:
        if not (editor and low[at : at + 1] and low[at] in ROUTINE_KINDS):
            return None
    if len(words) < at + 2 or words[at].lower() not in ROUTINE_KINDS:
        return None
    kind, first, *more = words[at].lower(), *words[at + 1 :]
    plain = _leading(first)
    typed = bool(more) and first in (plain, plain + "[]") and bool(_leading(more[0]))
    name = _leading(more[0]) if typed else plain
    if not name:
        return None
    return found | {"name": name, "is_event": False, "return_type": first if typed and kind == "function" else None}


def _ends(line: str) -> bool:
    words = line.lower().split(None, 2)
    return len(words) > 1 and words[0] == "end" and _leading(words[1]) in ROUTINE_KINDS + EVENT_KINDS


def _prototypes(line: str) -> str:
    """``opens`` or ``closes`` for the lines around prototypes."""
    low = line.lower()
    if "prototypes" not in low:
        return ""
    words = [_leading(w) for w in low.split(None, 2)[:2]]
    return {"forward": "opens", "type": "opens", "end": "closes"}.get(words[0], "") if words[1:] == ["prototypes"] else ""


#: What a line begins with that may declare, end or hide a routine; all others are passed over unread.
_MARKED = re.compile(r"\s*(?:end\S*\s+(?:subroutine|function|event|on|prototypes)|forward|type|public|protected|private|global|subroutine|function|event|on)", re.IGNORECASE).match


def routines_of(text: str, editor: bool = False) -> Iterator[dict]:
    """Routines in order, each up to its end line; prototypes are no routines. ``editor`` reads the editors' dialect, where access may be left out and events are those of objects."""
    lines, skipping = text.splitlines(), False
    marked = iter([i for i, line in enumerate(lines) if _MARKED(line)])
    for i in marked:
        s = lines[i].strip()
        skipping = {"opens": True, "closes": False}.get(_prototypes(s), skipping)
        found = None if skipping else declared(s, editor)
        if not found:
            continue
        end = next((k for k in marked if _ends(lines[k].strip())), len(lines))
        yield found | {"script": "\n".join(lines[i + 1 : end]), "line_start": i + 1, "line_end": min(end + 1, len(lines))}


def routines(sources: DataFrame, keys: list[str], text_col: str = "text", editor: bool = False) -> DataFrame:
    """A row per routine: ``keys`` and :data:`ROUTINE_SCHEMA`. The parser keeps state from line to line, so it runs in Arrow batches.

    A null text has no routines. ``editor`` reads the editors' dialect.
    """
    fields = sources.select(*keys).schema.fields
    schema = StructType([*fields, *StructType.fromDDL(ROUTINE_SCHEMA)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, r) for i, text in enumerate(batch.column(text_col).to_pylist()) for r in routines_of(text or "", editor)]
            if found:
                held = pa.RecordBatch.from_pylist([r for _, r in found], _ROUTINE_ARROW)
                at = pa.array([i for i, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(k).take(at) for k in keys] + held.columns, [*keys, *_ROUTINE_ARROW.names])

    return sources.select(*keys, text_col).mapInArrow(run, schema)


def measured(routine_rows: DataFrame) -> DataFrame:
    """Routines with their complexity, rating, deepest nesting and code lines."""
    cc = complexity(F.col("script"))
    return routine_rows.withColumns({"cc": cc, "rating": rating(cc), "nesting": max_nesting(F.col("script")), "code_lines": code_lines(F.col("script"))})


def variables(sources: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """Declarations in front of the first routine: ``access, data_type, name, initial_value``. Lines that declare several names at once are not read."""
    plain = F.regexp_replace(text_col, r"(?is)\b(?:forward|type)\s+prototypes\b.*?\bend\s+prototypes\b", "")
    header = F.regexp_extract(plain, r"(?ism)\A(.*?)(?=^[ \t]*(?:(?:public|protected|private|global)\s+(?:subroutine|function)\s|(?:event|on)\s+\w)|\z)", 1)
    # A declaration is three words, the first an access, before the equals sign if there is one.
    rows = sources.select(*keys, F.explode(F.split(header, "\r?\n")).alias("_line")).select(*keys, F.rtrim(F.col("_line"), F.lit(";" + WHITE)).alias("_line"))
    split = rows.select(*keys, F.split(stripped(F.substring_index("_line", "=", 1)), r"\s+").alias("_w"), F.when(F.col("_line").contains("="), stripped(F.substring("_line", F.locate("=", F.col("_line")) + 1, F.char_length("_line")))).otherwise("").alias("initial_value"))
    named = lambda i: F.get("_w", i).rlike(r"^[\w\[\]]+$")
    held = (F.size("_w") == 3) & F.lower(F.get("_w", 0)).isin(*ACCESS) & named(1) & named(2) & ~F.lower(F.get("_w", 1)).isin(*NO_DATA_TYPES)
    return split.where(held).select(*keys, F.lower(F.get("_w", 0)).alias("access"), F.get("_w", 1).alias("data_type"), F.get("_w", 2).alias("name"), "initial_value")


# Token classes in the order they are tried: fixed forms of the language. White space parts tokens and is none.
TOKENS = (
    ("export_header", r"\A\$PBExportHeader\$[^\n]*"),
    ("line_comment", r"//[^\n]*"),
    ("block_comment", r"/\*(?s:.*?)(?:\*/|\z)"),
    ("string", r'"(?:~(?s:.)|[^"~])*(?:"|\z)' + r"|'(?:~(?s:.)|[^'~])*(?:'|\z)"),
    ("number", r"-?\d+(?:\.\d*)?(?:[eE][+-]?\d+)?"),
    ("phrase", r"(?i:\b(?:end[ \t]+(?:if|choose|try|type|event|on|prototypes?|variables|loop|subroutine|function|forward)|choose[ \t]+case|do[ \t]+(?:while|until))\b)"),
    ("word", r"[\p{L}_][\p{L}\p{Nd}_!#]*"),
    ("left_parenthesis", r"\("),
    ("right_parenthesis", r"\)"),
    ("left_bracket", r"\["),
    ("right_bracket", r"\]"),
    ("dot", r"\."),
    ("semicolon", r";"),
    ("colon", r":"),
    ("escape", r"~(?s:.)"),
    ("operator", r"<>|<=|>=|\+=|-=|\*=|/=|\^=|[-+*/^=<>&]"),
    ("bad_character", r"\S"),
)
# Words of each class, the first class that has a word counts: fixed values of the language.
WORDS = (
    ("keyword", "if then else elseif choose case for to step next do while until loop continue exit return goto try catch finally throw create destroy call super parent this post dynamic not and or is null true false using within from global type forward event on prototype prototypes variables subroutine function constant autoinstantiate"),
    ("type", "integer int long longlong ulong uint dec decimal real double string blob char nchar date time datetime boolean any unsigned window menu datawindow datastore commandbutton singlelineedit multilineedit dropdownlistbox picture picturebutton graph progressbar tab userobject nonvisualobject transaction structure enumeration treeview listview datawindowchild richtextedit statictext groupbox checkbox radiobutton editmask powerobject oleobject olestream mailsession mailmessage inet hyperlink pipeline connection internetresult corbaobject mdiframe errorobject"),
    ("modifier", "public private protected shared instance global readonly constant"),
    ("constant", "hourglass! arrow! cross! beam! size! sizens! sizewe! sizenwse! sizenesw! hyperlink! append! choose! create! delete! filter! insert! modify! retrieve! update! cancel! close! dbcancel! dbe! eof! notmodified! ok! prompt! setcode! setfocus! userdefined! any! char! date! datetime! decimal! double! integer! long! real! string! time! unsignedinteger! unsignedlong! yes! no!"),
    ("sql_keyword", "select from where into values set insert update delete join left right inner outer full cross and or not in exists between like order by group having union all distinct as asc desc null is count sum avg min max create drop alter table index view procedure trigger execute immediate using dynamic cursor for read only fetch next prior first last close open declare section connect disconnect commit rollback transaction database powerbuilder"),
    ("report_function", "object data buffer modify describe insertrow deleterow setfilter setsort retrieve update reset rowsmove rowscopy rowsdiscard getitemstring getitemnumber getitemdate getitemdatetime setitem setcolumn settext gettext isselected selectrow groupcalc sharedata getchild getsqlselect setsqlselect importstring importfile export save print settransobject settrans getrow getclickedrow getselectedrow rowcount modifiedcount deletedcount filteredcount"),
)


def tokens(sources: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``position, kind, token`` for every token; words by the lists in :data:`WORDS`, others are names, phrases are keywords."""
    every = "|".join(p for _, p in TOKENS)
    found = sources.select(*keys, F.posexplode(F.regexp_extract_all(text_col, F.lit(f"({every})"), 1)).alias("position", "token"))
    kind = F.coalesce(*[F.when(F.col("token").rlike(rf"\A(?:{p})\z"), F.lit(k)) for k, p in TOKENS])
    low = F.lower("token")
    word = F.coalesce(*[F.when(low.isin(*words.split()), F.lit(k)) for k, words in WORDS], F.lit("name"))
    return found.withColumn("kind", F.when(kind == "word", word).when(kind == "phrase", "keyword").otherwise(kind))


def foldings(routine_rows: DataFrame, keys: list[str]) -> DataFrame:
    """First and last line of every routine that has more than one."""
    return routine_rows.where("line_end > line_start").select(*keys, "name", "line_start", "line_end")


def window_events(text: Column, most: int = 20) -> Column:
    """Distinct events of a window, system messages left out."""
    found = F.regexp_extract_all(text, F.lit(r"(?im)^[ \t]*event\s+(?:type\s+\w+\s+)?(\w+)"), 1)
    return F.slice(F.array_distinct(F.filter(found, lambda x: ~F.lower(x).startswith("pbm_"))), 1, most)


# Endings of a field's name and the screen type they stand for: fixed values.
FIELD_ENDINGS = (("Date", ("_date", "_time", "_dt")), ("number", ("_id", "_no", "_num", "_amt", "_qty", "_count")), ("boolean", ("_flag", "_yn", "_bool", "_active")))
# Types of the language and of a screen's code: fixed values.
SCREEN_TYPES = {"integer": "number", "long": "number", "double": "number", "decimal": "number", "string": "string", "boolean": "boolean", "datetime": "string", "date": "string", "time": "string", "any": "any", "void": "void"}


def guessed_type(column: Column) -> Column:
    """Type of a screen field by its name's ending."""
    c, out = F.lower(column), F.lit("string")
    for kind, endings in reversed(FIELD_ENDINGS):
        hit = F.lit(False)
        for e in endings:
            hit = hit | c.endswith(e)
        out = F.when(hit, kind).otherwise(out)
    return out


def report_fields(text: Column, most: int = 60) -> Column:
    """Distinct columns of a report object as ``(name, type)``, the first ``most``, types guessed."""
    names = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\bcolumn\s+name\s*=\s*[\"']?(\w+)"), 1), lambda x: F.lower(x))
    return F.transform(F.slice(F.array_distinct(names), 1, most), lambda x: F.struct(x.alias("name"), guessed_type(x).alias("type")))


def signature(text: Column, name: str) -> Column:
    """Return type and argument types of a function in a screen's types; any and no arguments where it is not declared."""
    pattern = rf"(?i)\bfunction\s+(\w+)\s+{re.escape(name)}\s*\(([^)]*)\)"
    kinds = F.create_map(*[F.lit(x) for pair in SCREEN_TYPES.items() for x in pair])
    of = lambda t: F.coalesce(F.try_element_at(kinds, F.lower(t)), F.lit("any"))
    arguments = F.filter(F.transform(F.split(F.regexp_extract(text, pattern, 2), ","), lambda x: F.trim(x)), lambda x: x.contains(" "))
    return F.struct(of(F.regexp_extract(text, pattern, 1)).alias("return_type"), F.transform(arguments, lambda x: of(F.regexp_extract(x, r"(\w+)\s+\w+\z", 1))).alias("argument_types"))
