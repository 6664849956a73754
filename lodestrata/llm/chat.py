"""Chat formatting in budgeted, turn-aligned windows, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the template. Roles and texts are escaped, so none of them occurs inside one.
START, BODY, END = "<|start|>", "<|message|>", "<|end|>"
#: Goes into the middle of a control string to break it; doubled where a text has it.
BREAK = "␛"
#: First characters of control strings, of this template and of common others, before the rest of one.
CONTROL = r"(<(?=\|)|<(?=/?s>)|<(?=</?SYS>>)|\[(?=/?INST\]))"
#: Tokens of a window: its new turns, the history it repeats and the system turn.
BUDGET = 2048
#: Tokens, and turns, of the window before that a window repeats.
HISTORY_TOKENS = 512
HISTORY_TURNS = 4
#: Tokens of the budget that are new turns' however long the system turn is; it is repeated whole up to the rest.
NEW_TOKENS = 256


def escape(text: Column) -> Column:
    """Break every control string, reversibly."""
    return F.regexp_replace(F.replace(text, F.lit(BREAK), F.lit(BREAK * 2)), CONTROL, f"$1{BREAK}")


def unescape(text: Column) -> Column:
    """What :func:`escape` was given."""
    return F.regexp_replace(text, f"{BREAK}({BREAK}?)", "$1")


def token_count(text: Column) -> Column:
    """Word characters by up to eight, single other characters, and white space by sixteen, so that tokens bound characters."""
    return F.regexp_count(text, F.lit(r"\w{1,8}+|[^\w\s]|\s{16}")).cast("long")


def windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS, new_tokens: int = NEW_TOKENS, tokens=token_count, assistant: str = "assistant", system: str = "system") -> DataFrame:
    """A row per training window: ``conv_id, window, formatted, n_repeated, n_turns, tokens, loss``.

    The budget holds everything that a window says. What history and the
    conversation's system turn take is set aside, but ``new_tokens`` at least
    are left for new turns. Prefix sums of the turns' tokens lay the turns in
    cells of that room. Turns inside a cell are one window; one that crosses
    from a cell to the next begins the next one's window if it fits beside its
    turns, and else stands alone. So windows begin and end with whole turns,
    and only a single turn can exceed the budget.

    Every window after the first repeats the leading system turn, and the
    last turns before it (at most ``history_turns`` and ``history_tokens``);
    these come first, ``n_repeated`` counts them, and they carry no loss. The
    system turn is whole wherever it fits: it is cut only if it is longer than
    ``budget - new_tokens``, or beside a turn that leaves less room, to as
    many characters as there are tokens left. History that does not fit is
    left out. So the output is at most a constant times the input. ``loss``
    lists ``(start, length)`` in code points of ``formatted``, one for each
    assistant turn that is new there.

    A null text or role is an empty one; a null conversation or turn is a
    value of its own, the turn before all others. Turns with one number go by
    role and text. An empty table gives no rows; other columns are not read.
    A conversation's turns are summed in order, so they meet in one task, but
    as a sorted stream that spills, and windows are bounded by the budget.
    """
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    zero = F.lit(0).cast("long")
    t = t.withColumn("tokens", tokens(F.col("text"))).withColumn("at", F.row_number().over(ordered))
    t = t.withColumn("lead", (F.col("at") == 1) & (F.col("role") == system))
    t = t.withColumn("before", F.coalesce(F.sum("tokens").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), zero))
    t = t.withColumn("system_tokens", F.coalesce(F.max(F.when(F.col("lead"), F.col("tokens"))).over(ordered.rowsBetween(Window.unboundedPreceding, 0)), zero))
    t = t.withColumn("room", F.greatest(F.lit(budget - history_tokens) - F.col("system_tokens"), F.lit(max(1, new_tokens)).cast("long")))
    t = t.withColumn("cell", F.floor(F.col("before") / F.col("room"))).withColumn("crosses", F.floor((F.col("before") + F.greatest(F.col("tokens"), zero + 1) - 1) / F.col("room")) > F.col("cell"))
    t = t.withColumn("together", F.coalesce(F.sum(F.when(~F.col("crosses"), F.col("tokens"))).over(Window.partitionBy("conv_id", "cell")), zero))
    t = t.withColumn("joins", F.col("crosses") & ~F.lead("crosses", 1, True).over(ordered) & (F.col("tokens") + F.lead("together", 1, 0).over(ordered) <= F.col("room")))
    opens = F.col("crosses") | F.when(F.lag("crosses", 1, False).over(ordered), ~F.lag("joins", 1, False).over(ordered)).otherwise(F.coalesce(F.col("cell") != F.lag("cell").over(ordered), F.lit(True)))
    t = t.withColumn("opens", opens).withColumn("window", F.sum(F.col("opens").cast("long")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return _formatted(t, budget, history_tokens, history_turns, budget - new_tokens, tokens, assistant)


def _formatted(t: DataFrame, budget: int, history_tokens: int, history_turns: int, system_most: int, tokens, assistant: str) -> DataFrame:
    backwards = Window.partitionBy("conv_id", "window").orderBy(F.desc("at"))
    spans = Window.partitionBy("conv_id")
    t = t.withColumn("back_turns", F.row_number().over(backwards)).withColumn("back_tokens", F.sum("tokens").over(backwards.rowsBetween(Window.unboundedPreceding, 0))).withColumn("windows", F.max("window").over(spans))
    recent = (F.col("back_turns") <= history_turns) & (F.col("back_tokens") <= history_tokens) & (F.col("window") < F.col("windows")) & ~F.col("lead")
    own = F.array(F.struct("window", F.lit(False).alias("repeated")))
    again = F.struct((F.col("window") + 1).alias("window"), F.lit(True).alias("repeated"))
    later = F.transform(F.sequence(F.lit(1).cast("long"), F.col("windows")), lambda w: F.struct(w.alias("window"), F.lit(True).alias("repeated")))
    places = F.when(F.col("lead") & (F.col("windows") > 0), F.concat(own, later)).when(recent, F.concat(own, F.array(again))).otherwise(own)
    short = F.when(F.col("tokens") > system_most, F.left("text", F.lit(max(0, system_most)))).otherwise(F.col("text"))
    placed = t.select("conv_id", "at", "role", "lead", F.when(F.col("lead"), short).alias("short"), "text", "tokens", F.explode(places).alias("place"))
    cut = F.col("lead") & F.col("place.repeated")
    placed = placed.select("conv_id", "place.*", "at", "role", "lead", F.when(cut, F.col("short")).otherwise(F.col("text")).alias("text"), F.when(cut, tokens(F.col("short"))).otherwise(F.col("tokens")).alias("tokens"))
    piece = F.struct("at", "repeated", "lead", "role", "text", "tokens")
    rows = placed.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.sum(F.when(~F.col("repeated"), F.col("tokens")).otherwise(0)).alias("new"), F.sum(F.when(F.col("repeated") & ~F.col("lead"), F.col("tokens")).otherwise(0)).alias("old"))
    # What a long turn leaves goes to the system turn first, then to the history if all of it fits.
    left = F.greatest(F.lit(budget) - F.col("new"), F.lit(0))
    held = lambda x: ~(x["repeated"] & x["lead"]) | (x["tokens"] <= left)
    rest = lambda x: F.left(x["text"], left.cast("int"))
    said = F.transform("p", lambda x: F.when(held(x), x).otherwise(x.withField("text", rest(x)).withField("tokens", tokens(rest(x)))))
    rows = rows.select("conv_id", "window", "new", "old", left.alias("left"), said.alias("p"))
    fits = F.col("old") <= F.col("left") - F.coalesce(F.get(F.filter(F.transform("p", lambda x: F.when(x["repeated"] & x["lead"], x["tokens"])), lambda n: n.isNotNull()), F.lit(0)), F.lit(0))
    stays = lambda x: ~x["repeated"] | (x["lead"] & (F.col("left") > 0)) | (~x["lead"] & F.col("fits"))
    rows = rows.withColumn("fits", fits).select("conv_id", "window", F.filter("p", stays).alias("p"))

    def written(x: Column) -> Column:
        head, body = F.concat(F.lit(START), escape(x["role"]), F.lit(BODY)), escape(x["text"])
        return F.struct(x["repeated"].alias("repeated"), F.concat(head, body, F.lit(END)).alias("s"), F.char_length(head).alias("skip"), F.char_length(body).alias("n"), (~x["repeated"] & (x["role"] == assistant)).alias("counts"), x["tokens"].alias("tokens"))

    rows = rows.select("conv_id", "window", F.transform("p", written).alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)").alias("loss"))
    walk = F.aggregate(
        "p",
        start,
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["s"])).alias("at"),
            F.when(x["counts"], F.concat(acc["loss"], F.array(F.struct((acc["at"] + x["skip"]).alias("start"), x["n"].cast("long").alias("length"))))).otherwise(acc["loss"]).alias("loss"),
        ),
    )
    total = F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["tokens"])
    return rows.select("conv_id", "window", F.concat_ws("", F.transform("p", lambda x: x["s"])).alias("formatted"), F.size(F.filter("p", lambda x: x["repeated"])).alias("n_repeated"), F.size("p").alias("n_turns"), total.alias("tokens"), walk["loss"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, what its windows say: ``conv_id, n_turns, turns, loss_text, formatted_chars``.

    ``turns`` is the list of ``(role, text)``, repeated turns left out;
    ``loss_text`` is all text under the loss mask in order. Both are read from
    the formatted strings alone.
    """
    bodies = F.transform(F.filter(F.split("formatted", F.lit(r"\Q" + START + r"\E")), lambda x: x != ""), lambda x: F.struct(unescape(F.substring_index(x, BODY, 1)).alias("role"), unescape(F.substring_index(F.substring_index(x, BODY, -1), END, 1)).alias("text")))
    loss = F.transform("loss", lambda x: unescape(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    each = formatted.select("conv_id", "window", F.slice(bodies, F.col("n_repeated") + 1, F.col("n_turns")).alias("new"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("chars"))
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "new", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    turns = F.flatten(F.transform("w", lambda x: x["new"]))
    return whole.select("conv_id", F.size(turns).cast("long").alias("n_turns"), turns.alias("turns"), F.concat_ws("", F.flatten(F.transform("w", lambda x: x["loss"]))).alias("loss_text"), "formatted_chars")


def turns_text(turns: Column) -> Column:
    """Role, line break, text, line break, for every turn."""
    return F.concat_ws("", F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
