"""Chat formatting in budgeted windows, all in column functions.

A conversation is cut into windows of whole turns. Prefix sums of turn tokens choose the cuts: the
body budget of a window is halved, a turn belongs to the half-budget step that its prefix sum ends
in, and a turn longer than a step stands alone; so a window's own turns never exceed the body
budget, unless a single turn does. Each window starts with the system turn of the conversation,
then repeats the last turns of the window before it, as far as the history budget goes. A system turn
longer than half the body budget is not retained in every window, or each would be little but that
turn: it is an ordinary turn then, kept whole, once. So only a window with one own turn can exceed the
budget, and only by that turn. Repeated turns are marked and take no part in the loss: each assistant
turn is a target exactly once.

Template of a turn: `<s>[INST]` mark `:` role `[/INST]` text `</s>`; mark is `o` for a window's own
turn and `r` for a repeated one. Inside roles and texts a backslash is doubled and a control string
gets one after its bracket (`<\\s>`); one regular expression takes both back, so nothing is lost.

Defined cases: null texts and roles are empty; turns are ordered by turn, role, text (nulls first);
repeated rows are turns of their own; null conv_id is a conversation; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .registry import query, table

BUDGET = 1024
HISTORY = 256
PER_TURN = 8


def escape(text: Column) -> Column:
    """Make control strings inside a text impossible; `unescape` is its inverse."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"([<\[])(/?(?:s>|INST\]))", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def approx_tokens(text: Column) -> Column:
    """A token for every four bytes, begun ones too."""
    return F.ceil(F.octet_length(text) / 4)


def format_windows(
    turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, count_tokens=approx_tokens
) -> DataFrame:
    """conv_id, window, formatted, loss: the windows of every conversation.

    `loss` lists the spans (code points, end exclusive) of `formatted` that are targets. The turns
    move once, by conversation; all window functions and groupings reuse that partitioning.
    """
    in_order = Window.partitionBy("conv_id").orderBy("_turn", "_role", "_text")
    by_pos = Window.partitionBy("conv_id").orderBy("pos")
    whole = Window.partitionBy("conv_id")
    texts = turns.select(
        "conv_id",
        F.col("turn").alias("_turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("_role"),
        F.coalesce(F.col("text"), F.lit("")).alias("_text"),
    )
    ranked = texts.withColumn("pos", F.row_number().over(in_order)).select(
        "conv_id",
        "pos",
        "_role",
        escape(F.col("_text")).alias("_esc"),
        ((F.col("pos") == 1) & (F.col("_role") == "system")).alias("_first"),
    )
    sized = ranked.withColumn("_tokens", (count_tokens(F.col("_esc")) + PER_TURN).cast("long")).withColumn(
        "_sys", F.col("_first") & (F.col("_tokens") <= (budget - history) // 2)
    )
    body_tokens = F.when(F.col("_sys"), F.lit(0)).otherwise(F.col("_tokens"))
    step = F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.col("_sys_tokens")) / 2))
    cut = (
        sized.withColumn("_sys_tokens", F.max(F.when(F.col("_sys"), F.col("_tokens")).otherwise(0)).over(whole))
        .withColumn("_step", step)
        .withColumn("_end", F.sum(body_tokens).over(by_pos))
        .withColumn(
            "_cut",
            F.when(F.col("_sys"), F.lit(None))
            .otherwise(
                F.floor((F.col("_end") - 1) / F.col("_step")) * 2 + (F.col("_tokens") <= F.col("_step")).cast("long")
            ),
        )
        .withColumn("_new", (F.col("_cut") != F.lag("_cut").over(by_pos)).cast("long"))
        .withColumn("window", F.coalesce(F.sum("_new").over(by_pos), F.lit(0)))
        .withColumn("_last", F.max("window").over(whole))
        .withColumn("_window_end", F.max("_end").over(Window.partitionBy("conv_id", "window")))
    )
    place = lambda window, mark: F.struct(window.cast("long").alias("window"), F.lit(mark).alias("mark"))
    none = F.array().cast("array<struct<window:bigint,mark:string>>")
    again = (
        F.when(
            F.col("_sys") & (F.col("_last") > 0),
            F.transform(F.sequence(F.lit(1), F.col("_last")), lambda w: place(w, "r")),
        )
        .when(
            ~F.col("_sys")
            & (F.col("window") < F.col("_last"))
            & (F.col("_window_end") - F.col("_end") + F.col("_tokens") <= history),
            F.array(place(F.col("window") + 1, "r")),
        )
        .otherwise(none)
    )
    placed = cut.select(
        "conv_id", "pos", "_role", "_esc", F.explode(F.concat(F.array(place(F.col("window"), "o")), again)).alias("_at")
    )
    head = F.concat(F.lit("<s>[INST]"), F.col("_at.mark"), F.lit(":"), escape(F.col("_role")), F.lit("[/INST]"))
    segments = placed.select(
        "conv_id",
        F.col("_at.window").alias("window"),
        "pos",
        F.concat(head, F.col("_esc"), F.lit("</s>")).alias("_segment"),
        F.length("_esc").alias("_length"),
        ((F.col("_at.mark") == "o") & (F.col("_role") == "assistant")).alias("_target"),
    )
    so_far = Window.partitionBy("conv_id", "window").orderBy("pos")
    ends = segments.withColumn("_to", F.sum(F.length("_segment")).over(so_far) - len("</s>"))
    span = F.struct((F.col("_to") - F.col("_length")).alias("start"), F.col("_to").alias("end"))
    return (
        ends.groupBy("conv_id", "window")
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", "_segment"))).alias("_all"),
            F.array_sort(F.collect_list(F.when(F.col("_target"), span))).alias("loss"),
        )
        .select(
            "conv_id",
            "window",
            F.array_join(F.transform("_all", lambda s: s["_segment"]), "").alias("formatted"),
            "loss",
        )
    )


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns, targets, formatted_chars, from formatted windows and loss spans alone."""
    pieces = F.filter(F.split("formatted", "</s>"), lambda p: F.startswith(p, F.lit("<s>[INST]o:")))
    head = lambda p: F.substring_index(p, "[/INST]", 1)
    role = lambda p: unescape(F.substr(head(p), F.lit(len("<s>[INST]o:") + 1)))
    text = lambda p: unescape(F.substr(p, F.length(head(p)) + len("[/INST]") + 1))
    target = lambda s: unescape(
        F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    )
    parsed = windows.withColumn("_own", pieces).select(
        "conv_id",
        "window",
        F.size("_own").alias("_n"),
        F.array_join(
            F.transform("_own", lambda p: F.concat(role(p), F.lit("\n"), text(p), F.lit("\n"))), ""
        ).alias("_turns"),
        F.array_join(F.transform("loss", target), "").alias("_targets"),
        F.length("formatted").alias("_chars"),
    )
    joined = lambda name: F.array_join(F.transform("_all", lambda w: w[name]), "")
    return (
        parsed.groupBy("conv_id")
        .agg(
            F.sum("_n").cast("long").alias("n_turns"),
            F.sum("_chars").cast("long").alias("formatted_chars"),
            F.count("*").alias("n_windows"),
            F.array_sort(F.collect_list(F.struct("window", "_turns", "_targets"))).alias("_all"),
        )
        .select(
            "conv_id",
            "n_turns",
            joined("_turns").alias("turns"),
            joined("_targets").alias("targets"),
            "formatted_chars",
            "n_windows",
        )
    )


SQL = rf"""
WITH given AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(turn, role)),
turns AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g') AS esc,
    regexp_replace(replace(role, '\', '\\'), '([<\[])(/?(?:s>|INST\]))', '\1\\\2', 'g') AS esc_role,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM given)),
sized AS (
  SELECT *, pos = 1 AND role = 'system' AND tokens <= {(BUDGET - HISTORY) // 2} AS sys
  FROM (SELECT *, CAST(ceil(strlen(esc) / 4) AS BIGINT) + {PER_TURN} AS tokens FROM turns)),
ended AS (
  SELECT *, coalesce(max(tokens) FILTER (WHERE sys) OVER (PARTITION BY conv_id), 0) AS sys_tokens,
    sum(CASE WHEN sys THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY pos) AS upto FROM sized),
cut AS (
  SELECT *, CASE WHEN NOT sys THEN ((upto - 1) // step) * 2 + (tokens <= step)::INT END AS c
  FROM (SELECT *, greatest(1, ({BUDGET - HISTORY} - sys_tokens) // 2) AS step FROM ended)),
steps AS (SELECT *, coalesce((c <> lag(c) OVER (PARTITION BY conv_id ORDER BY pos))::INT, 0) AS new FROM cut),
placed AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY pos) AS win FROM steps),
wide AS (
  SELECT *, max(win) OVER (PARTITION BY conv_id) AS last_win, max(upto) OVER (PARTITION BY conv_id, win) AS win_end,
    length('<s>[INST]o:' || esc_role || '[/INST]' || esc || '</s>') AS chars FROM placed)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars * (1 + CASE WHEN sys THEN last_win
    WHEN win < last_win AND win_end - upto + tokens <= {HISTORY} THEN 1 ELSE 0 END)) AS BIGINT) AS formatted_chars,
  CAST(max(last_win) + 1 AS BIGINT) AS n_windows
FROM wide GROUP BY conv_id
"""


@query("op3_chat_windows", SQL)
def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of all formatted conversations and of one whose texts are control strings."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    back = read_back(format_windows(given.unionByName(hostile)))
    return back.select(
        "conv_id",
        "n_turns",
        F.sha2("turns", 256).alias("turns_sha256"),
        F.length("targets").cast("long").alias("loss_chars"),
        F.sha2("targets", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )
