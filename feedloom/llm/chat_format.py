"""Chat formatting in budgeted windows, with loss masks.

A conversation is cut into windows of whole turns.  Prefix sums of the turns' tokens choose the
spans: a window takes turns as long as they fit into `budget` tokens together with the system
turn (if the first turn is one) and up to `history` tokens of whole turns before them, which are
repeated as context.  The loss mask covers the assistant turns of the span only, so every target
is learnt once; repeated ones are masked.  A turn longer than the budget has a window of its own.

Tokens are bounded from above, without a vocabulary: `bytes_written` counts the UTF-8 bytes of a
turn as it is written, marks, role and escapes included.  A token of a byte-level or byte-fallback
vocabulary stands for one byte at least, so a window of at most `budget` has no more tokens than
that in any language.  Another count may be given.

Long conversations are first cut into blocks of about `block` tokens by the same prefix sums, so
that no row ever holds more than a block; a block borrows the system turn and the history turns
that come before it.  Only DataFrame functions are used; turns move once, by conversation.

Template: `<|im_start|>role\\ntext<|im_end|>\\n`.  A control string inside a text or role gets a
backslash behind its first character (one more if it has some), which reading back takes away,
so any text survives.  Newlines and % in roles are written as %0A and %25.

Turns are ordered by turn (nulls first), then role and text as written.  Null text and role count
as empty.  A null conversation id is a conversation of its own.  Repeated rows are turns of their
own.  Other columns, whatever their names, take no part.  An empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common templates, without their first character: after "<", and after "[".
AFTER_LT = ("|im_start|>", "|im_end|>", "|endoftext|>", "s>", "/s>", "<SYS>>", "</SYS>>")
AFTER_SQ = ("INST]", "/INST]")


def _rest(parts: tuple[str, ...]) -> str:
    special = "\\|/[]<>"
    return "|".join("".join("\\" + c if c in special else c for c in p) for p in parts)


def escape(c: Column) -> Column:
    """One backslash more behind the first character of every control string."""
    lt = F.regexp_replace(c, f"<(\\\\*)({_rest(AFTER_LT)})", r"<\\$1$2")
    return F.regexp_replace(lt, f"\\[(\\\\*)({_rest(AFTER_SQ)})", r"[\\$1$2")


def unescape(c: Column) -> Column:
    lt = F.regexp_replace(c, f"<\\\\(\\\\*)({_rest(AFTER_LT)})", r"<$1$2")
    return F.regexp_replace(lt, f"\\[\\\\(\\\\*)({_rest(AFTER_SQ)})", r"[$1$2")


def write_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def read_role(c: Column) -> Column:
    return F.replace(F.replace(unescape(c), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def bytes_written(turn: Column) -> Column:
    """Tokens of a turn as it is written, at most."""
    return F.octet_length(turn).cast("long")


def formatted(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = 4096, history: int = 1024, block: int = 1 << 19, count=bytes_written) -> DataFrame:
    """One row a window: conv, window, formatted, loss_spans, n_repeated, n_turns, tokens.

    loss_spans: array<struct<start, end>> in code points of `formatted`; n_repeated: turns of
    context at the front; n_turns: turns of the span.  budget, history, block: in the units of
    `count`, a function of a written turn.
    """
    said = F.coalesce(F.col(f"`{role}`"), F.lit(""))
    base = turns.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), said.alias("role"), F.concat(F.lit(OPEN), write_role(said), F.lit("\n")).alias("head"), escape(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("body"))
    order = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "body")
    whole = W.partitionBy("conv")
    rows = base.withColumn("tokens", count(F.concat("head", "body", F.lit(CLOSE)))).withColumn("no", F.row_number().over(order)).withColumn("to", F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumn("start", F.col("to") - F.col("tokens"))
    # the history that fits before a turn begins where the prefix sum is at most `history` smaller
    reach = W.partitionBy("conv").orderBy("start").rangeBetween(-history, 0)
    has_system = F.max(F.when((F.col("no") == 1) & (F.col("role") == "system"), 1).otherwise(0)).over(whole)
    rows = rows.withColumn("system", has_system)
    own = (F.col("no") > F.col("system")).cast("int")  # the system turn is no history
    rows = rows.withColumn("past", F.min(F.when(own == 1, F.struct("no", "start"))).over(reach))
    rows = rows.withColumn("block", F.floor(F.col("start") / block)).withColumn("last", F.max("block").over(whole))
    is_system = (F.col("no") == 1) & (F.col("system") == 1)
    # a turn goes to its block, to the next one if it may be history there, and a system turn to all
    after = F.floor((F.col("to") + history) / block)
    blocks = F.when(is_system, F.sequence("block", "last")).when((after > F.col("block")) & (F.col("block") < F.col("last")), F.array(F.col("block"), F.col("block") + 1)).otherwise(F.array("block"))
    item = F.struct("no", "role", "head", "body", "tokens", "start", "to", "past", (F.col("block") < F.col("b")).alias("old"))
    packs = rows.withColumn("b", F.explode(blocks)).groupBy("conv", "b", "system").agg(F.sort_array(F.collect_list(item)).alias("t"))

    packs = packs.select("conv", "b", F.when(F.col("system") == 1, F.col("t")[0]).alias("sys"), F.filter("t", lambda x: x["no"] > F.col("system")).alias("t"))
    # spans by one fold over the turns; only numbers are carried
    room = F.lit(budget) - F.coalesce(F.col("sys")["tokens"], F.lit(0))
    none = F.array().cast("array<struct<first:int,end:int,past:int,start:bigint>>")

    def step(a: Column, x: Column) -> Column:
        """A turn joins the open span, or opens the next."""
        open_ = F.element_at(a, -1)
        fits = (F.size(a) > 0) & (x["to"] - open_["start"] <= room)
        grown = F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(open_["first"].alias("first"), (x["no"] + 1).alias("end"), open_["past"].alias("past"), open_["start"].alias("start"))))
        # history gives way where it and the turn do not fit together
        close = x["to"] - x["past"]["start"] <= room
        fresh = F.concat(a, F.array(F.struct(x["no"].alias("first"), (x["no"] + 1).alias("end"), F.when(close, x["past"]["no"]).otherwise(x["no"]).alias("past"), F.when(close, x["past"]["start"]).otherwise(x["start"]).alias("start"))))
        return F.when(x["old"], a).when(fits, grown).otherwise(fresh)

    alone = F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("end"), F.lit(0).alias("past"), F.lit(0).cast("bigint").alias("start")))
    span = F.when((F.size("t") == 0) & (F.col("b") == 0), alone).otherwise(F.aggregate("t", none, step))
    packs = packs.select("conv", "b", "sys", "t", F.coalesce(F.col("t")[0]["no"], F.lit(0)).alias("low"), span.alias("s"))
    cut = F.transform("s", lambda s: F.struct(s["first"].alias("first"), s["past"].alias("past"), F.slice("t", s["past"] - F.col("low") + 1, s["end"] - s["past"]).alias("t")))
    windows = packs.select("conv", "b", "sys", F.posexplode(cut).alias("w", "s"))
    # only a conversation's first window owns its system turn
    owns = (F.col("b") == 0) & (F.col("w") == 0) & F.col("sys").isNotNull()
    bare = lambda x: F.struct(x["head"].alias("head"), x["body"].alias("body"), x["role"].alias("role"), x["tokens"].alias("tokens"))
    lead = F.when(F.col("sys").isNotNull(), F.array(bare(F.col("sys")))).otherwise(F.array().cast("array<struct<head:string,body:string,role:string,tokens:bigint>>"))
    used = F.concat(lead, F.transform(F.col("s")["t"], bare))
    repeated = (F.col("s")["first"] - F.col("s")["past"]) + F.when(F.col("sys").isNotNull() & ~owns, 1).otherwise(0)
    out = windows.select("conv", "b", "w", used.alias("p"), repeated.alias("r"))
    close = len(CLOSE)
    spans = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("p") - 1)),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("m")),
        lambda a, i: _advance(a, F.get(F.col("p"), i), i >= F.col("r"), close),
    )["m"]
    return out.select(
        F.col("conv").alias(conv),
        F.struct("b", "w").alias("window"),
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"),
        spans.alias("loss_spans"),
        F.col("r").alias("n_repeated"),
        (F.size("p") - F.col("r")).alias("n_turns"),
        F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("tokens"),
    )


def _advance(a: Column, x: Column, own: Column, close: int) -> Column:
    """Past turn x; its body is a target if it is the assistant's and not repeated."""
    start = a["at"] + F.char_length(x["head"])
    end = start + F.char_length(x["body"])
    mask = F.when(own & (x["role"] == "assistant"), F.concat(a["m"], F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))))).otherwise(a["m"])
    return F.struct((end + close).cast("long").alias("at"), mask.alias("m"))


def read_back(windows: DataFrame) -> DataFrame:
    """Add to windows of `formatted`: turns (array<struct<role, text>>, repeated ones left out) and loss_text."""
    parts = F.slice(F.split("formatted", "<\\|im_end\\|>\n"), F.col("n_repeated") + 1, F.col("n_turns"))
    bare = F.transform(parts, lambda x: F.substr(x, F.lit(len(OPEN) + 1)))
    turns = F.transform(bare, lambda x: F.struct(read_role(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substr(x, F.char_length(F.substring_index(x, "\n", 1)) + 2)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"] + 1, s["end"] - s["start"]))), "")
    return windows.withColumn("turns", turns).withColumn("loss_text", loss)
