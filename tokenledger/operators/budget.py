"""Budgets replayed over turns: what was used before each, and what it would make of the budgets."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger import staging
from tokenledger.functions.text import half_up
from tokenledger.operators.carry import running_before, sums_before
from tokenledger.operators.pricing import local_day, output_multiplier, projected_output, with_learnt
from tokenledger.settings import DEFAULTS, Settings


def with_projection(turns: DataFrame, s: Settings = DEFAULTS, multipliers: DataFrame | None = None) -> DataFrame:
    """turns with projected (their context and expected output) and spent (what they are billed for).

    multipliers: (model, multiplier) learnt from history. A turn whose skipped
    is true, where that is a column, was answered by an earlier one and spends nothing.
    """
    turns, own = with_learnt(turns, multipliers)
    m = output_multiplier(F.col("model"), s, own)
    spent = F.col("input_tokens") + F.ceil(F.col("output_tokens") * m).cast("long")
    if "skipped" in turns.columns:
        spent = F.when(F.col("skipped"), F.lit(0).cast("long")).otherwise(spent)
    return turns.withColumn("projected", F.col("input_tokens") + projected_output(F.col("input_tokens"), m)).withColumn("spent", spent).drop("learnt")


def verdict(session_after: Column, day_after: Column, s: Settings = DEFAULTS) -> tuple[Column, Column]:
    """(level, budget): over from the whole of a budget on, warn from the warning share on; the session's is named first."""
    level, budget = F.lit("ok"), F.lit(None).cast("string")
    for share, word in ((s.warn_pct, "warn"), (100, "over")):
        a, b = session_after * 100 >= s.session_budget * share, day_after * 100 >= s.daily_budget * share
        level = F.when(a | b, word).otherwise(level)
        budget = F.when(a, "session").when(b, "daily").otherwise(budget)
    return level, budget


def shown(rows: DataFrame, s: Settings) -> DataFrame:
    """rows (session_used, day_used, projected) with percentages, level and budget."""
    a, b = F.col("session_used") + F.col("projected"), F.col("day_used") + F.col("projected")
    level, budget = verdict(a, b, s)
    return rows.withColumns({"session_pct": half_up(a * 100.0 / s.session_budget), "day_pct": half_up(b * 100.0 / s.daily_budget), "level": level, "budget": budget})


#: Open turns of an owner's day, its earliest, that one round takes in order.
FOLDED = 2048

#: Turns of a day in order: what has run before each, and which run.
_FOLD = """
aggregate(turns, named_struct('used', 0L, 'ran', cast(array() AS array<bigint>)),
  (a, x) -> if(x.day_base + a.used + x.projected < {daily}, named_struct('used', a.used + x.spent, 'ran', concat(a.ran, array(x.seq))), a))
"""


def _run_of_days(open_: DataFrame, s: Settings, day: list[str]) -> DataFrame:
    """(seq) of the turns (seq, day, projected, spent, day_base) that run if only the day's budget stops turns.

    Rounds: turns that stay below the budget with all open ones before them
    counted run, the first FOLDED open ones of a day are taken in order, and of
    the later ones those stay open that fit beside what has run of these.
    """
    spent, kept, parts = F.col("spent"), [], []
    fits = lambda used: F.col("day_base") + F.col(used) + F.col("projected") < s.daily_budget
    open_ = open_.select("seq", *day, "projected", "spent", "day_base")
    while True:
        most = sums_before(open_, day, "seq", {"most": spent, "place": F.lit(1).cast("long")})
        most = staging.save(most.withColumn("runs", fits("most")).drop("most"), "budget-round")
        lists = most.where(F.col("place") < FOLDED).groupBy(*day).agg(F.array_sort(F.collect_list(F.struct("seq", "projected", "spent", "day_base"))).alias("turns"))  # FOLDED turns at most
        told = staging.save(lists.select(*day, F.expr(_FOLD.format(daily=int(s.daily_budget))).alias("told")).select(*day, "told.used", "told.ran"), "budget-told")
        long = most.where(F.col("place") == FOLDED).select(*day)  # a row for FOLDED turns at most
        used = F.broadcast(long.join(told.select(*day, "used"), day, "left").withColumn("used", F.coalesce("used", F.lit(0).cast("long"))))
        later = staging.save(most.where(F.col("place") >= FOLDED).join(used, day).where(F.col("runs") | fits("used")).drop("place", "used"), "budget-later")
        kept += [most, told, later]
        parts += [told.select(F.explode("ran").alias("seq")), later.where("runs").select("seq")]
        if later.where("NOT runs").isEmpty():
            break
        # what ran for certain among later turns, and all that ran of the first ones
        sure = F.when(F.col("runs"), spent).otherwise(F.lit(0).cast("long"))
        left = running_before(later, day, "seq", sure, "ran").where("NOT runs").join(used, day).withColumn("day_base", F.col("day_base") + F.col("used") + F.col("ran"))
        open_ = left.where(F.col("day_base") + F.col("projected") < s.daily_budget).drop("runs", "ran", "used")
    ran = staging.save(functools.reduce(DataFrame.unionByName, parts), "budget-ran")
    for done in kept:
        staging.discard(done)
    return ran


def running_turns(rows: DataFrame, s: Settings, session: list[str], day: list[str]) -> DataFrame:
    """(seq) of the turns that hard blocking lets run. rows: seq, the keys, projected, spent, and session_base and day_base, used before all of them.

    A turn is stopped if what ran before it in its session or in its owner's
    day, and its own projection, reach a budget; one that is stopped adds
    nothing to either. So each verdict rests on earlier ones of all sessions of
    the day. Days are run as if no session's budget were reached. Then the
    sessions are summed up: days with a turn that ran over its session's budget
    are watched from then on, and run again with the turns left out that their
    sessions stop, until these stay the same. Verdicts that agree with all that
    ran before them are those of the turns taken in order: the first one that
    differed would rest on equal ones. A day that is not watched is read once.
    """
    keys = [*dict.fromkeys([*session, *day])]
    spent, projected, zero = F.col("spent"), F.col("projected"), F.lit(0).cast("long")
    # a turn of unknown projection is never stopped
    rows = rows.select("seq", *keys, F.coalesce(projected, F.lit(-(1 << 62))).alias("projected"), F.coalesce(spent, zero).alias("spent"), "session_base", "day_base")
    rows = staging.save(rows.where((F.col("session_base") + projected < s.session_budget) & (F.col("day_base") + projected < s.daily_budget)), "budget-turns")
    first = _run_of_days(rows, s, day)
    kept = [rows, first]
    state = rows.join(first, "seq").withColumns({"watched": F.lit(False), "runs": F.lit(True), "fits": F.lit(True)})
    while True:

        def summed(turns: DataFrame) -> DataFrame:
            out = running_before(turns, session, "seq", F.when(F.col("runs"), spent).otherwise(zero), "used")
            out = staging.save(out.withColumn("now", F.col("session_base") + F.col("used") + projected < s.session_budget).drop("used"), "budget-sessions")
            kept.append(out)
            return out

        state = summed(state)
        over = staging.save(state.where("NOT watched AND NOT now").select(*day).distinct(), "budget-over")
        kept.append(over)
        if not over.isEmpty():
            more = rows.join(over, day, "left_semi").join(state.where("NOT watched").select("seq", "runs"), "seq", "left")
            more = more.withColumns({"watched": F.lit(True), "runs": F.coalesce("runs", F.lit(False)), "fits": F.lit(True)})
            state = summed(state.drop("now").join(over, day, "left_anti").unionByName(more))
        if state.where("watched AND now <> fits").isEmpty():
            break
        again = _run_of_days(state.where("watched AND now"), s, day)
        kept.append(again)
        state = state.drop("fits").withColumnRenamed("now", "fits").join(again.withColumn("again", F.lit(True)), "seq", "left")
        state = state.withColumn("runs", F.when(F.col("watched"), F.coalesce("again", F.lit(False))).otherwise(F.col("runs"))).drop("again")
    ran = staging.save(state.where("runs").select("seq"), "budget-running")
    for done in kept:
        staging.discard(done)
    return ran


def metered(rows: DataFrame, s: Settings, session: list[str], day: list[str]) -> DataFrame:
    """rows (seq, keys, projected, spent, session_base, day_base) with session_used and day_used before each; with hard_block, blocked, and spent 0 where it is true."""
    if s.hard_block:
        ran = running_turns(rows, s, session, day).withColumn("runs", F.lit(True))
        rows = rows.join(ran, "seq", "left").withColumn("blocked", F.col("runs").isNull()).drop("runs").withColumn("spent", F.when(F.col("blocked"), F.lit(0).cast("long")).otherwise(F.col("spent")))
    rows = running_before(rows, session, "seq", F.col("spent"), "session_used")
    rows = running_before(rows, day, "seq", F.col("spent"), "day_used")
    return rows.withColumns({"session_used": F.col("session_used") + F.col("session_base"), "day_used": F.col("day_used") + F.col("day_base")})


def budget_replay(turns: DataFrame, s: Settings = DEFAULTS, owner: str = "session_id", daily_owner: str = "project", multipliers: DataFrame | None = None) -> DataFrame:
    """turns (seq, ts, model, input_tokens, output_tokens) with session_used and day_used before each, the percentages with its projection, level, budget.

    The session's budget counts per owner, the day's per daily_owner and day,
    over all sessions (turns without a time share one); is_reset, where it is a
    column, starts an owner's session anew. With hard_block a turn that would be
    over adds nothing to either, and blocked says so. multipliers: (model,
    multiplier) learnt from history.
    """
    rows = with_projection(turns, s, multipliers).withColumn("day_", F.coalesce(local_day(F.col("ts"), s).cast("string"), F.lit("")))
    keys = [owner]
    if "is_reset" in turns.columns:
        rows = sums_before(rows, [owner], "seq", {"segment": F.col("is_reset").cast("long")}).withColumn("segment", F.col("segment") + F.col("is_reset").cast("long"))
        keys = [owner, "segment"]
    rows = rows.withColumns({"session_base": F.lit(0).cast("long"), "day_base": F.lit(0).cast("long")})
    return shown(metered(rows, s, keys, [daily_owner, "day_"]), s).drop("day_", "session_base", "day_base")
