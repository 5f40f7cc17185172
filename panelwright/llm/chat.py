"""Chat formatting with budgeted, turn-aligned windows.

The template marks a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``. A text that holds the start of a
control string gets one backslash more between ``<`` and ``|`` (``<|`` becomes ``<\\|``, ``<\\|`` becomes
``<\\\\|``), so no text can look like a mark, and taking one backslash away restores it. Roles are escaped
likewise, and their backslashes and line feeds as well.

Every window holds the conversation's system turn (its first turn, if the role is ``system``), whose
tokens are taken off the budget first. The rest, less HISTORY, is the window's share S for new turns, at
least one token. A conversation is cut at turns by prefix sums of turn tokens: with C the tokens up to a
turn's end, the system turn aside, a turn belongs to span floor((C - 1) / S). Turns that lie within one
span are at most S tokens; the turn that crosses into the span from before stays with them if the sum
allows and else is a window of its own. Only a turn that is longer than S by itself exceeds the share.

After the system turn each window repeats, as limited history, up to HISTORY_TURNS turns from before it,
as far as HISTORY and what the budget leaves beside system turn and new turns allow. So a window exceeds
the budget only if it has a single new turn that does so together with the system turn.

The loss mask, character spans of the formatted window, covers the texts of its new assistant turns only:
targets repeated as history are masked, so each assistant text is a target exactly once.

Everything is DataFrame expressions. One shuffle by conversation serves all windows and sums; a
conversation is one training text, so its turns meet in one task, but its texts are put together window
by window.

Edge cases: null texts and roles are empty; turns are ordered by (turn, role, text), so repeated turn
numbers have a defined place and repeated rows stay; an empty text has an empty span; a null conv_id is a
conversation of its own. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a window, those of the history in it, and its turns.
BUDGET, HISTORY, HISTORY_TURNS = 512, 96, 2
#: Tokens counted for a turn's marks and role.
MARKS = 4


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", "<$1|")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(c: Column) -> Column:
    """Undoes ``escape_role``: doubled backslashes are set aside while single ones are read as escapes."""
    parts = F.split(unescape(c), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def tokens(text: Column) -> Column:
    """The default token count: a quarter of the characters, rounded up, and the marks."""
    return F.ceil(F.char_length(text) / 4).cast("long") + MARKS


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, history_turns: int = HISTORY_TURNS, count=tokens) -> DataFrame:
    """(conv_id, window, n_repeated, n_turns, formatted, loss_spans) of ``turns(conv_id, turn, role, text)``.

    The first ``n_repeated`` turns of ``formatted`` are system turn and history. ``loss_spans`` holds
    (start, length) pairs in characters.
    """
    conv = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    all_before = conv.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("tok", count(F.col("text"))).withColumn("nth", F.row_number().over(conv))
    is_system = (F.col("nth") == 1) & (F.col("role") == "system")
    body = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit(END + "\n"))
    t = t.withColumns({"body": body, "load": F.when(is_system, 0).otherwise(F.col("tok")), "system_tok": F.first(F.when(is_system, F.col("tok")).otherwise(0)).over(all_before)})
    t = t.withColumns({"cum": F.sum("load").over(all_before), "share": F.greatest(budget - history - F.col("system_tok"), F.lit(1))})
    t = t.withColumn("span", F.floor((F.col("cum") - 1) / F.col("share")))
    t = t.withColumn("crosses", F.col("cum") - F.col("load") < F.col("span") * F.col("share"))
    in_span = Window.partitionBy("conv_id", "span")
    t = t.withColumn("together", F.max("cum").over(in_span) - F.min(F.col("cum") - F.col("load")).over(in_span) <= F.col("share"))
    # a window's number: two per span, the first for a crossing turn that must stand alone; the system turn opens the first
    t = t.withColumn("window", F.col("span") * 2 + F.when(F.col("crosses") & ~F.col("together"), 0).otherwise(1))
    t = t.withColumn("window", F.when(is_system, F.coalesce(F.lead("window").over(conv), F.lit(1))).otherwise(F.col("window")))
    left = budget - F.col("system_tok") - F.sum("load").over(Window.partitionBy("conv_id", "window"))
    t = t.withColumn("spare", F.least(F.lit(history), F.greatest(left, F.lit(0))))
    earlier = conv.rowsBetween(-history_turns, -1)
    past = F.collect_list(F.struct("nth", "role", "tok", "body")).over(earlier)
    system = F.first(F.when((F.col("nth") == 1) & (F.col("role") == "system"), F.col("body"))).over(all_before)
    first_of = F.lag("window").over(conv).isNull() | (F.lag("window").over(conv) != F.col("window"))
    t = t.withColumn("opens", first_of)
    t = t.withColumn("past", F.when(F.col("opens"), past)).withColumn("system", F.when(F.col("opens") & (F.col("nth") > 1), system))
    # history: the latest turns that fit, the system turn aside
    fits = F.filter("past", lambda p: ~((p["nth"] == 1) & (p["role"] == "system")))
    kept = F.aggregate(
        F.reverse(fits),
        F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<string>").alias("bodies"), F.lit(True).alias("open")),
        lambda a, p: F.when(
            a["open"] & (a["sum"] + p["tok"] <= F.col("spare")),
            F.struct((a["sum"] + p["tok"]).alias("sum"), F.concat(F.array(p["body"]), a["bodies"]).alias("bodies"), F.lit(True).alias("open")),
        ).otherwise(F.struct(a["sum"].alias("sum"), a["bodies"].alias("bodies"), F.lit(False).alias("open"))),
    )["bodies"]
    repeated = F.concat(F.when(F.col("system").isNotNull(), F.array("system")).otherwise(F.array().cast("array<string>")), kept)
    t = t.withColumn("repeated", F.when(F.col("opens"), repeated))
    in_window = Window.partitionBy("conv_id", "window").orderBy("nth")
    t = t.withColumn("base", F.first(F.char_length(F.array_join("repeated", ""))).over(in_window))
    t = t.withColumn("at", F.col("base") + F.sum(F.char_length("body")).over(in_window) - F.char_length("body"))
    start = F.col("at") + F.char_length(F.lit(START)) + F.char_length(escape_role(F.col("role"))) + 1
    span = F.when(F.col("role") == "assistant", F.struct(start.cast("int").alias("start"), F.char_length(escape(F.col("text"))).alias("length")))
    return (
        t.groupBy("conv_id", "window")
        .agg(
            F.max(F.size("repeated")).alias("n_repeated"),
            F.count(F.lit(1)).alias("n_turns"),
            F.first("repeated", ignorenulls=True).alias("repeated"),
            F.sort_array(F.collect_list(F.struct("nth", "body"))).alias("own"),
            F.sort_array(F.collect_list(span)).alias("loss_spans"),
        )
        .select("conv_id", "window", "n_repeated", "n_turns", F.array_join(F.concat("repeated", F.transform("own", lambda o: o["body"])), "").alias("formatted"), "loss_spans")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, window, turns, targets, n_chars): the new turns (role, text) and target texts read from formatted windows."""
    parts = F.split("formatted", F.lit("<\\|im_end\\|>\n"), -1)
    fresh = F.slice(parts, F.col("n_repeated") + 1, F.size(parts) - 1 - F.col("n_repeated"))

    def turn(p: Column) -> Column:
        inner = F.substring(p, len(START) + 1, F.char_length(p))
        role = F.substring_index(inner, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substring(inner, F.char_length(role) + 2, F.char_length(inner))).alias("text"))

    target = lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))
    return formatted.select("conv_id", "window", F.transform(fresh, turn).alias("turns"), F.transform("loss_spans", target).alias("targets"), F.char_length("formatted").cast("long").alias("n_chars"))


def digests(turns: DataFrame) -> DataFrame:
    """Formats, reads back and sums up each conversation."""
    read = read_back(windows(turns))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    by = read.select("conv_id", F.struct("window", text.alias("text"), F.array_join("targets", "").alias("loss")).alias("w"), F.size("turns").alias("n"), "n_chars").groupBy("conv_id").agg(
        F.sort_array(F.collect_list("w")).alias("w"), F.sum("n").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows")
    )
    whole, loss = (F.array_join(F.col("w")[k], "") for k in ("text", "loss"))
    return by.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


def oracle(budget: int = BUDGET, history: int = HISTORY) -> str:
    """DuckDB SQL of the digests over ``conversations`` and the control conversation."""
    return rf"""
with src as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
esc as (
  select *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') as etext,
    regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') as erole,
    ceil(length(text) / 4.0)::bigint + {MARKS} as tok from src),
num as (
  select *, length('{START}') + length(erole) + 1 + length(etext) + length('{END}') + 1 as len,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as nth from esc),
sys as (select conv_id, tok as system_tok from num where nth = 1 and role = 'system'),
ld as (
  select num.*, coalesce(system_tok, 0) as system_tok, case when nth = 1 and role = 'system' then 0 else tok end as load,
    greatest({budget} - {history} - coalesce(system_tok, 0), 1) as share from num left join sys using (conv_id)),
sm as (select *, sum(load) over (partition by conv_id order by nth) as cum from ld),
sp as (select *, floor((cum - 1) / share)::bigint as span from sm),
tg as (
  select *, cum - load < span * share as crosses,
    max(cum) over (partition by conv_id, span) - min(cum - load) over (partition by conv_id, span) <= share as together from sp),
cut as (select *, span * 2 + case when crosses and not together then 0 else 1 end as win0 from tg),
pos as (select *, case when nth = 1 and role = 'system' then coalesce(lead(win0) over (partition by conv_id order by nth), 1) else win0 end as win from cut),
win as (select *, least({history}, greatest({budget} - system_tok - sum(load) over (partition by conv_id, win), 0)) as spare from pos),
op as (
  select *, coalesce(lag(win) over w <> win, true) as opens,
    first_value(case when nth = 1 and role = 'system' then len else 0 end) over w as system_len,
    first_value(role) over w as first_role,
    lag(tok, 1) over w as t1, lag(tok, 2) over w as t2, lag(len, 1) over w as l1, lag(len, 2) over w as l2
  from win window w as (partition by conv_id order by nth)),
rep as (
  select conv_id, len, role, text, nth, opens,
    case when opens and nth > 1 then system_len else 0 end as sys,
    case when opens and nth > 1 and not (nth = 2 and first_role = 'system') and t1 <= spare then l1 else 0 end as h1,
    case when opens and nth > 2 and t1 <= spare and not (nth = 3 and first_role = 'system') and t1 + t2 <= spare then l2 else 0 end as h2
  from op)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by nth)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by nth) filter (role = 'assistant'), '')) as loss_sha256,
  sum(len + sys + h1 + h2)::bigint as formatted_chars,
  count(*) filter (opens)::bigint as n_windows
from rep group by conv_id
"""
