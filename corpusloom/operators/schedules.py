"""Schedules: next runs, due runs, run records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HORIZON_DAYS = 8 * 366 + 366  # days ahead that are searched: 29 February can be eight years away, and further on a given weekday

# fixed values: bounds of the five cron fields and names of months and days
_FIELDS = [("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 6)]
_NAMES = {n: i for i, n in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)} | {n: i for i, n in enumerate("mon tue wed thu fri sat sun".split())}


def cron_values(expression: str) -> dict[str, list[int]] | None:
    """Values each of the five fields allows; None if the expression is no
    crontab.  Weekdays count from Monday, as 0; 7 in the last field is Sunday
    of the common notation, where Sunday is 0."""
    parts = (expression or "").lower().split()
    if len(parts) != len(_FIELDS):
        return None
    out = {}
    for part, (name, low, high) in zip(parts, _FIELDS):
        values: set[int] = set()
        for item in part.split(","):
            span, _, step = item.partition("/")
            first, dash, last = span.partition("-")
            try:
                if span == "*":
                    a, b = low, high
                else:
                    a = _number(first, name)
                    b = _number(last, name) if dash else (high if step else a)
                by = int(step) if step else 1
            except ValueError:
                return None
            if by < 1 or a < low or b > high or a > b:
                return None
            values |= set(range(a, b + 1, by))
        out[name] = sorted(values)
    return out


def _number(text: str, field: str) -> int:
    if text in _NAMES:
        return _NAMES[text]
    value = int(text)
    # numbers count weekdays from Sunday, as 0 or 7
    return (value - 1) % 7 if field == "weekday" else value


def next_cron(expression: str, after: Column) -> Column:
    """First minute after a time that a crontab expression allows, null if none
    within the horizon or if the expression is invalid.  Day and weekday must
    both fit."""
    allowed = cron_values(expression)
    if allowed is None:
        return F.lit(None).cast("timestamp")
    start = F.date_trunc("minute", after) + F.expr("interval 1 minute")
    days = F.sequence(F.to_date(start), F.date_add(F.to_date(start), HORIZON_DAYS))
    fits = lambda d: F.month(d).isin(allowed["month"]) & F.dayofmonth(d).isin(allowed["day"]) & F.weekday(d).isin(allowed["weekday"])
    minutes = F.array(*[F.lit(h * 60 + m) for h in allowed["hour"] for m in allowed["minute"]])
    good = F.filter(days, fits)
    times = F.flatten(F.transform(F.slice(good, 1, 2), lambda d: F.transform(minutes, lambda m: d.cast("timestamp") + F.make_dt_interval(mins=m))))
    return F.array_min(F.filter(times, lambda t: t >= start))


def next_runs(schedules: DataFrame, now: Column, expressions: list[str] | None = None) -> DataFrame:
    """(id, name, next_run) of active schedules.

    `cron` by its expression, `interval` a whole number of intervals after its
    last run (or now, if it never ran) and after `now`, `once` at its time if that
    is still to come; others have none.  `expressions` are the cron expressions
    that occur, read from the table if not given - a schedule table is small.
    """
    if expressions is None:
        rows = schedules.where("schedule_type = 'cron'").select("cron_expression").distinct().limit(10_001).collect()
        if len(rows) > 10_000:
            raise ValueError("more than 10000 cron expressions")
        expressions = sorted(r.cron_expression for r in rows if r.cron_expression)
    cron = F.lit(None).cast("timestamp")
    for expression in expressions:
        cron = F.when(F.col("cron_expression") == expression, next_cron(expression, now)).otherwise(cron)
    every = F.col("interval_seconds")
    base = F.coalesce("last_run", now)
    passed = F.floor((F.unix_timestamp(now) - F.unix_timestamp(base)) / every) + 1
    interval = F.timestamp_seconds(F.unix_timestamp(base) + F.greatest(passed, F.lit(1)) * every)
    once = F.when(F.col("run_at") > now, F.col("run_at"))
    kind = F.col("schedule_type")
    return schedules.where("status = 'active'").select("id", "name", F.when(kind == "cron", cron).when((kind == "interval") & (every > 0), interval).when(kind == "once", once).alias("next_run"))


def due(schedules: DataFrame, now: Column) -> DataFrame:
    """Active schedules whose time has come: intervals passed since the last run
    or never run, single runs at or after their time that never ran."""
    every = F.col("interval_seconds")
    interval = F.col("last_run").isNull() | (F.unix_timestamp("last_run") + every <= F.unix_timestamp(now))
    once = F.col("last_run").isNull() & (F.col("run_at") <= now)
    kind = F.col("schedule_type")
    return schedules.where("status = 'active'").where(F.when(kind == "interval", interval).when(kind == "once", once).otherwise(False))


def run_counts(schedules: DataFrame, runs: DataFrame) -> DataFrame:
    """Schedules with the number of their runs and the start of the last."""
    counted = runs.groupBy("schedule_id").agg(F.count("*").alias("runs"), F.max("started_at").alias("last_started"))
    return schedules.select("id", "name", "status").join(counted.withColumnRenamed("schedule_id", "id"), "id", "left").withColumn("runs", F.coalesce("runs", F.lit(0)))


def set_status(schedules: DataFrame, schedule_id: int, status: str) -> DataFrame:
    """Schedules with one paused, resumed or completed."""
    return schedules.withColumn("status", F.when(F.col("id") == schedule_id, status).otherwise(F.col("status")))


def after_run(schedules: DataFrame, schedule_id: int, started: Column) -> DataFrame:
    """Schedules after a run: counted and dated; single runs are completed."""
    hit = F.col("id") == schedule_id
    return schedules.withColumns({
        "last_run": F.when(hit, started).otherwise(F.col("last_run")), "run_count": F.when(hit, F.col("run_count") + 1).otherwise(F.col("run_count")),
        "status": F.when(hit & (F.col("schedule_type") == "once"), "completed").otherwise(F.col("status")),
    })


def interval_seconds(hours: Column) -> Column:
    return (hours * 3600).cast("long")


def parse_run_at(text: Column) -> Column:
    """Time of an ISO text, null if it is none."""
    return F.try_to_timestamp(text)
