"""Chat formatting by quotation linking.

Lines that start with ``>`` quote, nested by their number; lines of one level
behind each other are a passage. A passage is normalised across its line breaks
and hashed: its windows of ``WINDOW`` words, its lines, and itself if it has
fewer words. So are the own words of each message. What a passage and an earlier
message of the conversation have in common names the first message that says
it; a quote that was wrapped anew, cut or run together still links. A message
answers the earlier message that its shallowest quotes come from; these links
make threads, and a conversation is put in the order of threads, answers behind
what they answer, with the quotes taken out.

Only hashes and turns are exchanged for linking, of conversations with quotes
alone, and a passage that very many messages quote is not exchanged by its hash.
The order in a conversation comes from a range sort over all conversations, so
a long one is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bucket_count, hot_join, remove, written
from .minhash import let

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKET_BYTES = 8 << 20
#: Words of a hashed window.
WINDOW = 5


def lines(text: Column) -> Column:
    """``array<struct<level, said>>``: how many marks each line starts with, and the line behind them."""
    mark = lambda x: F.regexp_extract(x, r"^([ \t]*>)*", 0)
    of = lambda x: F.struct(F.length(F.regexp_replace(mark(x), "[^>]", "")).alias("level"), F.regexp_replace(x, r"^([ \t]*>)+[ \t]?", "").alias("said"))
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: of(x))


def normalised(line: Column) -> Column:
    """A-Z lower-cased, ASCII white space to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(F.translate(line, _UPPER, _LOWER), "[ \\t-\\r]+", " "))


def without_quotes(parsed: Column) -> Column:
    """The unquoted lines, without empty ones at the ends."""
    kept = F.array_join(F.transform(F.filter(parsed, lambda x: x["level"] == 0), lambda x: x["said"]), "\n")
    return F.regexp_replace(F.regexp_replace(kept, "^[ \\t-\\r]+", ""), "[ \\t-\\r]+$", "")


def passages(parsed: Column) -> Column:
    """``array<struct<level, lines>>``: the runs of lines of one level, from 1 on, that have words; lines are normalised."""
    runs = lambda p, starts: F.transform(starts, lambda s, k: F.struct(F.get(p, s)["level"].alias("level"), _said(F.slice(p, s + 1, F.coalesce(F.get(starts, k + 1), F.size(p)) - s)).alias("lines")))
    starts = lambda p: F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: (i == 0) | (F.get(p, i)["level"] != F.get(p, i - 1)["level"]))
    return F.filter(let(parsed, lambda p: let(starts(p), lambda x: runs(p, x))), lambda r: (r["level"] > 0) & (F.size(r["lines"]) > 0))


def _said(parsed: Column) -> Column:
    """The normalised lines that have words."""
    return F.filter(F.transform(parsed, lambda x: normalised(x["said"])), lambda x: x != "")


def units(conv: Column, lines_: Column) -> Column:
    """Distinct hashes of what normalised lines say: their windows over all line breaks, themselves, and all of them if they are fewer words."""
    of = lambda x: F.xxhash64(conv, x)
    windows = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: of(F.array_join(F.slice(w, i, WINDOW), " ")))
    joined = lambda w: F.when(F.size(w) >= WINDOW, windows(w)).otherwise(F.array(of(F.array_join(w, " "))))
    return F.when(F.size(lines_) > 0, F.array_distinct(F.concat(F.transform(lines_, of), let(F.split(F.array_join(lines_, " "), " "), joined)))).otherwise(F.array().cast("array<bigint>"))


def answers(messages: DataFrame, conv_col: str, turn_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """``conv, turn, parent, n_linked`` of each message whose quotes name an earlier one."""
    told = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(text_col).alias("text")).where("conv is not null and turn is not null")
    rows = told.select("conv", "turn", lines(F.col("text")).alias("parsed"))
    quoted = rows.select("conv", "turn", F.posexplode(passages(F.col("parsed"))).alias("passage", "p"))
    quoted = scratch.written(quoted.select("conv", "turn", "passage", "p.level", F.explode(units(F.col("conv"), F.col("p.lines"))).alias("hash")), "quoted")
    asked = quoted.groupBy("hash").agg(F.count("*").alias("n"))
    # Of conversations with quotes alone; a very long one stays where it is.
    quoting = scratch.written(told.groupBy("conv").agg(F.count("*").alias("n")).join(quoted.select("conv").distinct(), "conv"), "quoting")
    own = hot_join(told, quoting, "conv").select("conv", "turn", lines(F.col("text")).alias("parsed"))
    own = own.select("turn", F.explode(units(F.col("conv"), _said(F.filter("parsed", lambda x: x["level"] == 0)))).alias("hash"))
    first = scratch.written(own.groupBy("hash").agg(F.min("turn").alias("origin")).join(asked, "hash"), "origins")
    found = hot_join(quoted, first, "hash").where("origin < turn")
    by_origin = found.groupBy("conv", "turn", "level", "origin").agg(F.count("*").alias("n"), F.collect_set("passage").alias("from"))
    best = by_origin.groupBy("conv", "turn").agg(F.max(F.struct((-F.col("level")).alias("depth"), "n", "origin")).alias("best"), F.size(F.array_distinct(F.flatten(F.collect_list("from")))).cast("long").alias("n_linked"))
    return best.select("conv", "turn", F.col("best.origin").alias("parent"), "n_linked")


def _place(conv: str, turn: str) -> Column:
    return F.struct(F.col(conv).alias("conv"), F.col(turn).alias("turn"))


def threads(links: DataFrame, max_rounds: int = 40, scratch: Scratch | None = None) -> DataFrame:
    """``conv, turn, parent, n_linked, root, depth``: each round doubles the steps up the thread.

    A message that very many answer goes to its answers, so these stay where they are.
    The table that the result reads goes with ``scratch``, else it stays.
    """
    spark = links.sparkSession
    state, path = written(links.withColumn("root", F.col("parent")).withColumn("depth", F.lit(1).cast("long")), "threads")
    for _ in range(max_rounds):
        asked = state.groupBy(_place("conv", "root").alias("at")).agg(F.count("*").alias("n"))
        up = state.select(_place("conv", "turn").alias("at"), F.col("root").alias("next"), F.col("depth").alias("more")).join(asked, "at")
        up, of = written(up, "up")
        if up.isEmpty():
            remove(spark, of)
            if scratch:
                scratch.paths.append(path)
            return state
        moved = hot_join(state.withColumn("at", _place("conv", "root")), up, "at", how="left")
        new = moved.select("conv", "turn", "parent", "n_linked", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        state, after = written(new, "threads")
        remove(spark, path)
        remove(spark, of)
        path = after
    raise RuntimeError(f"threads did not settle in {max_rounds} rounds")


def reply_ordered(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_col, position, turn, role, body, parent_turn, root_turn, depth, n_quoted, n_linked`` for each row.

    ``position`` is gapless from 0 in a conversation: by the first turn of the
    thread, then by depth, turn, role and body (nulls first), so an answer comes
    behind what it answers. A message that quotes nothing known opens a thread.
    ``n_quoted`` and ``n_linked`` count quoted passages. Of origins at the
    shallowest level that of most hashes wins, then the later one. Null texts count as empty; rows with a null conversation or turn are not
    linked but keep their place; rows that repeat a turn answer and are answered
    as one; quotes of later turns link nothing. Texts of any length are read
    whole: a row's lines and windows are arrays of that row. An empty table stays empty.
    Other columns are not read.
    """
    slim = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).cast("string").alias("text"))
    scratch = Scratch(messages.sparkSession)
    found = threads(answers(slim, "conv", "turn", "text", scratch), scratch=scratch)
    # Rows without a conversation or turn have no key and are not exchanged, rows of one turn in great number neither.
    placed = F.when(F.col("conv").isNotNull() & F.col("turn").isNotNull(), _place("conv", "turn"))
    said = found.select(_place("conv", "turn").alias("at"), "parent", "n_linked", "root", "depth")
    linked = scratch.written(said.join(slim.groupBy(placed.alias("at")).agg(F.count("*").alias("n")), "at"), "linked")
    parsed = hot_join(slim.withColumn("at", placed), linked, "at", how="left").withColumn("parsed", lines(F.col("text")))
    bare = parsed.select("conv", "turn", "role", without_quotes(F.col("parsed")).alias("body"), F.size(passages(F.col("parsed"))).cast("long").alias("n_quoted"), "parent", "n_linked", "root", "depth")
    rows = bare.select("conv", "turn", "role", "body", "n_quoted", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "parent", F.coalesce("root", "turn").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"))
    order = ["root", "depth", "turn", "role", "body"]
    n = bucket_count(slim, BUCKET_BYTES)
    # The range of each row is kept by writing it: a second run could sample other bounds.
    ranged, _ = written(rows.repartitionByRange(n, "conv", *order).withColumn("range", F.spark_partition_id()), "ranges")
    scratch.clear()
    inside = Window.partitionBy("conv", "range").orderBy(*order)
    counts = ranged.groupBy("conv", "range").agg(F.count("*").alias("n"))
    # Sorted by conversation, so it is in neighbouring ranges: a row for each.
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("conv").alias("c"), F.col("range").alias("r"), "before")
    placed = ranged.withColumn("place", F.row_number().over(inside) - 1)
    joined = placed.join(before, placed["conv"].eqNullSafe(before["c"]) & (placed["range"] == before["r"]))
    return joined.select(F.col("conv").alias(conv_col), (F.col("before") + F.col("place")).cast("long").alias("position"), "turn", "role", "body", F.col("parent").alias("parent_turn"), F.col("root").alias("root_turn"), "depth", "n_quoted", "n_linked")
