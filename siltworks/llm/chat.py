"""Chat formatting in budgeted windows, with DataFrame functions only.

Turns get a token count. In each chunk of CHUNK turn numbers, running sums of the counts choose spans of whole turns that leave
room for the conversation's system turn and for history. Each span becomes one training text: the system turn (if it opens the
conversation and lies before the span), the last turns of the span before up to the history budget, then the span's own turns. All
these together stay within the budget; only a turn that is alone above it makes a longer window, and then nothing is added to it. Only
assistant turns that are the span's own are targets of the loss, so a turn that is repeated as history is masked there.

Template: each turn is ``<s>role`` + newline + text + ``</s>``. In texts, a backslash is put behind the opening bracket of every
control string (``<s> </s> [INST] [/INST] <|`` and the same with backslashes behind the bracket); taking one away again restores
the text exactly. In roles, ``% < [`` and newlines are percent-encoded.

Defined results: null texts and roles are empty; turns with equal or null numbers follow each other by role and text, nulls
last; a system turn that does not fit beside a long turn is left out there; rows with a null conversation id form one conversation; repeated rows are turns
of their own; an empty table gives no row. Only the four named columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 256
#: Spans end where a chunk of so many turn numbers ends, so that one long conversation is not one task's work.
CHUNK = 1024

TOKEN = r"\w+|[^\w\s]"
CONTROL = r"([<\[])(\\*)(/?s>|/?INST\]|\|)"
ESCAPED = r"([<\[])\\(\\*)(/?s>|/?INST\]|\|)"
OPEN, CLOSE = "<s>", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, r"$1$2$3")


def escape_role(role: Column) -> Column:
    for plain, code in (("%", "%25"), ("<", "%3C"), ("[", "%5B"), ("\n", "%0A")):
        role = F.replace(role, F.lit(plain), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for plain, code in (("\n", "%0A"), ("[", "%5B"), ("<", "%3C"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return role


SPANS = "array<struct<low:int,high:int,tokens:bigint>>"


def choose_spans(turns: Column, room: Column) -> Column:
    """Of turns (nth, tokens) in order, spans (low, high, tokens): a span ends before the turn that would take it beyond the room."""
    span = lambda low, high, tokens: F.struct(low.alias("low"), high.alias("high"), tokens.alias("tokens"))
    start = F.struct(F.array().cast(SPANS).alias("closed"), span(F.lit(1), F.lit(0), F.lit(0).cast("long")).alias("open"))

    def step(state: Column, x: Column) -> Column:
        at = state["open"]
        full = (at["high"] >= at["low"]) & (at["tokens"] + x["tokens"] > room)
        closed = F.when(full, F.concat(state["closed"], F.array(at))).otherwise(state["closed"])
        return F.struct(closed.alias("closed"), F.when(full, span(x["nth"], x["nth"], x["tokens"])).otherwise(span(at["low"], x["nth"], at["tokens"] + x["tokens"])).alias("open"))

    return F.aggregate(turns, start, step, lambda state: F.concat(state["closed"], F.array(state["open"])))


def format_windows(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per span: conv_id, span, tokens, formatted, repeated (turns that are not the span's own), n_turns, loss (array of start, length).

    History comes from the span before, so each turn but the system turn is written twice at most.
    """
    if not 0 <= history <= budget:
        raise ValueError("history must lie between 0 and the budget")
    role, text = F.coalesce(F.col(f"`{role_col}`"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    turn = F.coalesce(F.col(f"`{turn_col}`").cast("long"), F.lit((1 << 63) - 1))
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        turn.alias("turn"),
        role.alias("role"),
        text.alias("text"),
        (F.regexp_count(text, F.lit(TOKEN)) + 4).cast("long").alias("tokens"),
        F.floor(turn / CHUNK).alias("chunk"),
    )
    opening = rows.groupBy(F.col("conv_id").alias("c")).agg(F.min(F.struct("turn", "role", "text", "tokens")).alias("x")).where("x.role = 'system'")
    opening = opening.select("c", F.col("x.text").alias("system"), F.col("x.tokens").alias("system_tokens"))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")))

    # One row per chunk; numbers only.
    chunks = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("nth", "tokens"))).alias("sizes"))
    by_chunk = Window.partitionBy("conv_id").orderBy("chunk")
    chunks = chunks.withColumn("place", F.row_number().over(by_chunk))
    chunks = chunks.join(opening, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    opens = F.col("system").isNotNull() & (F.col("place") == 1)  # the chunk's first turn is the system turn, for which all spans leave room
    weighed = F.transform("sizes", lambda x: F.struct(x["nth"].alias("nth"), F.when(opens & (x["nth"] == 1), 0).otherwise(x["tokens"]).cast("long").alias("tokens")))
    reserved = F.coalesce(F.col("system_tokens"), F.lit(0))
    chunks = chunks.withColumn("spans", choose_spans(weighed, F.greatest(budget - history - reserved, F.lit(0))))
    left = lambda x: F.greatest(F.lit(0), budget - x["tokens"] - F.when(x["tokens"] + reserved <= budget, reserved).otherwise(0))
    chunks = chunks.withColumn("spare", F.transform("spans", lambda x: F.least(F.lit(history), left(x))))  # for history
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.withColumn("first_span", F.coalesce(F.sum(F.size("spans")).over(earlier), F.lit(0)))
    chunks = chunks.withColumn("next_spare", F.concat(F.slice("spare", 2, CHUNK * CHUNK), F.array(F.lead(F.element_at("spare", 1)).over(by_chunk))))  # null: no span follows

    numbered = F.transform("spans", lambda x, i: F.struct((F.col("first_span") + i).cast("long").alias("span"), x["low"].alias("low"), x["high"].alias("high"), F.get("next_spare", i).alias("next_spare")))
    ends = F.transform("sizes", lambda x: x["tokens"])
    by = chunks.select(F.col("conv_id").alias("c"), F.col("chunk").alias("h"), numbered.alias("spans"), ends.alias("ends"), opens.alias("opens"))
    placed = rows.join(by, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("h")))
    placed = placed.withColumn("at", F.filter("spans", lambda x: (x["low"] <= F.col("nth")) & (F.col("nth") <= x["high"]))[0])
    to_end = F.aggregate(F.slice("ends", F.col("nth"), F.col("at.high") - F.col("nth") + 1), F.lit(0).cast("long"), lambda n, x: n + x)
    again = ~(F.col("opens") & (F.col("nth") == 1)) & F.coalesce(to_end <= F.col("at.next_spare"), F.lit(False))
    place = F.struct(F.col("chunk").alias("chunk"), F.col("nth").alias("nth")).alias("place")
    use = lambda span, own: F.struct(span.alias("span"), F.lit(own).alias("own"))
    own = use(F.col("at.span"), True)
    copied = placed.withColumn("use", F.explode(F.when(again, F.array(own, use(F.col("at.span") + 1, False))).otherwise(F.array(own))))
    copied = copied.select("conv_id", F.col("use.span").alias("span"), F.col("use.own").alias("own"), place, "role", "text", "tokens")
    before_all = F.struct(F.lit(-(1 << 63)).cast("long").alias("chunk"), F.lit(0).alias("nth")).alias("place")
    repeats = chunks.where("system is not null").select("conv_id", F.posexplode("spans").alias("i", "x"), "first_span", "system", "system_tokens", opens.alias("opens"))
    repeats = repeats.where((~F.col("opens") | (F.col("i") > 0)) & (F.col("x.tokens") + F.col("system_tokens") <= budget))
    repeats = repeats.select("conv_id", (F.col("first_span") + F.col("i")).cast("long").alias("span"), F.lit(False).alias("own"), before_all, F.lit("system").alias("role"), F.col("system").alias("text"), F.col("system_tokens").alias("tokens"))
    used = copied.unionByName(repeats)

    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    used = used.withColumn("head", head).withColumn("body", escape(F.col("text")))
    written = F.concat("head", "body", F.lit(CLOSE))
    target = F.col("own") & (F.col("role") == "assistant")
    piece = F.struct("place", "tokens", written.alias("written"), F.col("own"), F.char_length("head").alias("skip"), F.when(target, F.char_length("body")).otherwise(-1).alias("loss"), F.char_length(written).alias("chars"))
    windows = used.groupBy("conv_id", "span").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def step(state: Column, x: Column) -> Column:
        mark = F.struct((state["at"] + x["skip"]).alias("start"), x["loss"].alias("length"))
        return F.struct((state["at"] + x["chars"]).alias("at"), F.when(x["loss"] >= 0, F.concat(state["loss"], F.array(mark))).otherwise(state["loss"]).alias("loss"))

    return windows.select(
        "conv_id",
        "span",
        F.aggregate("pieces", F.lit(0).cast("long"), lambda n, x: n + x["tokens"]).alias("tokens"),
        F.array_join(F.transform("pieces", lambda x: x["written"]), "").alias("formatted"),
        F.size(F.filter("pieces", lambda x: ~x["own"])).alias("repeated"),
        F.size("pieces").alias("n_turns"),
        F.aggregate("pieces", start, step, lambda state: state["loss"]).alias("loss"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted texts and loss marks alone: its turns, the text under the loss mask, and lengths."""
    parts = F.split(F.substring(F.col("formatted"), len(OPEN) + 1, 1 << 30), "</s><s>|</s>$", -1)
    turns = F.transform(F.slice(parts, F.col("repeated") + 1, F.col("n_turns") - F.col("repeated")), lambda x: F.concat(unescape_role(F.substring_index(x, "\n", 1)), F.lit("\n"), unescape(F.substr(x, F.locate("\n", x) + 1)), F.lit("\n")))
    under = F.transform("loss", lambda m: unescape(F.substr(F.col("formatted"), m["start"] + 1, m["length"])))
    read = windows.select("conv_id", "span", turns.alias("turns"), F.array_join(under, "").alias("under"), F.char_length("formatted").cast("long").alias("chars"))
    whole = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("span", "turns", "under"))).alias("spans"), F.sum("chars").alias("formatted_chars"))
    said = F.array_join(F.flatten(F.transform("spans", lambda x: x["turns"])), "")
    loss = F.array_join(F.transform("spans", lambda x: x["under"]), "")
    return whole.select(
        "conv_id",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + F.size(x["turns"])).alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
