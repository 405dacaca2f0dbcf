"""Personal ledgers, economic indicators and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days that a range name covers; others cover a year (fixed values).
RANGES = {"1M": 31, "3M": 93, "5Y": 1826}
YEAR = 366
PRIORITIES = ["LOW", "MEDIUM", "HIGH", "URGENT"]


def month_of(ts: Column) -> Column:
    return F.trunc(ts, "month")


def totals(ledger: DataFrame) -> DataFrame:
    """Sum and count by user, month and type."""
    return ledger.groupBy("user_id", "month", "type").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))


def by_category(ledger: DataFrame) -> DataFrame:
    return ledger.where("type = 'EXPENSE'").groupBy("user_id", "month", "category").agg(F.sum("amount").alias("amount"), F.count("*").alias("n"))


def monthly_summary(ledger: DataFrame, budgets: DataFrame) -> DataFrame:
    """Income, expense, balance, budget (0 without one) and what remains of it, and the expenses by category: an array of
    (category, amount, n) by category."""
    zero = F.lit(0).cast("decimal(19,2)")
    kind = lambda t: F.coalesce(F.sum(F.when(F.col("type") == t, F.col("amount"))), zero)
    s = ledger.groupBy("user_id", "month").agg(kind("INCOME").alias("income"), kind("EXPENSE").alias("expense"))
    per = by_category(ledger).groupBy("user_id", "month").agg(F.sort_array(F.collect_list(F.struct("category", "amount", "n"))).alias("breakdown"))
    s = s.join(budgets.select("user_id", "month", F.col("amount").alias("budget")), ["user_id", "month"], "left").join(per, ["user_id", "month"], "left")
    s = s.withColumn("budget", F.coalesce("budget", zero)).withColumn("breakdown", F.coalesce("breakdown", F.array().cast(per.schema["breakdown"].dataType)))
    return s.withColumns({"balance": F.col("income") - F.col("expense"), "remaining": F.col("budget") - F.col("expense")})


def month_range(key: Column, as_of: Column) -> Column:
    """(key, start, end) of a month given as yyyy-MM; anything else is the month of ``as_of``. Times are UTC, the end excluded."""
    k = F.when(F.rlike(key, F.lit(r"^\d{4}-(0[1-9]|1[0-2])$")), key).otherwise(F.date_format(as_of, "yyyy-MM"))
    start = F.to_date(F.concat(k, F.lit("-01")))
    return F.struct(k.alias("key"), start.cast("timestamp").alias("start"), F.add_months(start, 1).cast("timestamp").alias("end"))


def local_date(as_of: Column, timezone: Column) -> Column:
    """The calendar date of a zone at a time."""
    return F.date_format(F.from_utc_timestamp(as_of, timezone), "yyyy-MM-dd")


def row_errors(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """First failing check of each ledger row: amount over 0, category there, not archived, of its type."""
    c = categories.select(F.col("category"), F.col("type").alias("category_type"), "archived")
    j = rows.join(c, "category", "left")
    error = (
        F.when(F.col("amount").isNull() | (F.col("amount") <= 0), "AMOUNT_INVALID").when(F.col("category_type").isNull(), "CATEGORY_NOT_FOUND")
        .when(F.col("archived"), "CATEGORY_ARCHIVED").when(F.col("category_type") != F.col("type"), "CATEGORY_TYPE_MISMATCH")
    )
    return j.withColumn("error", error).drop("category_type", "archived")


def latest_observations(obs: DataFrame, n: int = 2) -> DataFrame:
    """The n newest observations of each indicator; place 1 is the latest, 2 the one before."""
    return obs.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.col("observed_at").desc_nulls_last()))).where(F.col("place") <= n)


def changes(obs: DataFrame) -> DataFrame:
    """Change and per cent change against the observation before; 0 % where that was 0."""
    before = F.lag("value").over(Window.partitionBy("key").orderBy("observed_at"))
    o = obs.withColumn("previous", before).withColumn("change_value", F.col("value") - F.col("previous"))
    return o.withColumn("change_pct", F.when(F.col("previous").isNull(), None).when(F.col("previous") == 0, F.lit(0.0)).otherwise(F.col("change_value") / F.col("previous") * 100))


def in_range(obs: DataFrame, name: str, as_of: str) -> DataFrame:
    return obs.where(F.col("observed_at") >= F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(RANGES.get(name, YEAR))))


def priority_ordinal(priority: Column) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in PRIORITIES]), priority)


def open_tasks(tasks: DataFrame) -> DataFrame:
    """Open tasks in order: most urgent first, then the earliest due, none due last."""
    order = Window.partitionBy("user_id").orderBy(priority_ordinal(F.col("priority")).desc(), F.col("due_at").asc_nulls_last(), "task_id")
    return tasks.where(F.col("status").isin("TODO", "IN_PROGRESS")).withColumn("place", F.row_number().over(order))


def task_page(tasks: DataFrame, page: int, size: int = 20) -> DataFrame:
    """One page of each user's tasks that aren't cancelled, with the total."""
    w = Window.partitionBy("user_id")
    t = tasks.where("status <> 'CANCELLED'").withColumn("total", F.count("*").over(w))
    t = t.withColumn("place", F.row_number().over(w.orderBy(F.col("due_at").asc_nulls_last(), F.col("created_at").desc(), "task_id")))
    return t.where(F.col("place").between((page - 1) * size + 1, page * size))


def task_brief(tasks: DataFrame, as_of: str, upcoming: int = 5) -> DataFrame:
    """Overdue, today's, and the first upcoming open tasks of each user (no due date counts as upcoming)."""
    now = F.lit(as_of).cast("timestamp")
    bucket = F.when(F.col("due_at") < F.date_trunc("day", now), "overdue").when(F.to_date("due_at") == F.to_date(now), "today").otherwise("upcoming")
    t = open_tasks(tasks).withColumn("bucket", bucket)
    t = t.withColumn("in_bucket", F.row_number().over(Window.partitionBy("user_id", "bucket").orderBy("place")))
    return t.where((F.col("bucket") != "upcoming") | (F.col("in_bucket") <= upcoming))


def recurrence_errors(type_: Column, interval: Column, weekdays: Column, lunar_days: Column, starts: Column, until: Column) -> Column:
    """All failing checks of a recurrence rule."""
    none = F.lit(None).cast("string")
    has = lambda a: F.coalesce(F.size(a) > 0, F.lit(False))
    checks = [
        F.when(until.isNull(), "RECURRENCE_END_REQUIRED"), F.when((type_ == "WEEKLY") & ~has(weekdays), "RECURRENCE_WEEKDAY_REQUIRED"),
        F.when((type_ == "LUNAR_MONTHLY") & ~has(lunar_days), "RECURRENCE_LUNAR_DAY_REQUIRED"), F.when(until > starts + F.expr("interval 1 year"), "RECURRENCE_RANGE_TOO_LONG"),
        F.when(until < starts, "RECURRENCE_RANGE_INVALID"),
    ]
    return F.when(type_ == "NONE", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(*[F.coalesce(c, none) for c in checks])))


def next_occurrence(type_: Column, interval: Column, weekdays: Column, timezone: Column, until: Column, after: Column, preferred: Column) -> Column:
    """Next time of a DAILY or WEEKLY rule after ``after``: daily by its interval; weekly on the next listed ISO
    weekday of the zone at the preferred UTC time; null past ``until`` or without one."""
    daily = after + F.make_interval(days=interval)
    at = F.date_trunc("day", after) + F.make_interval(hours=F.hour(preferred), mins=F.minute(preferred), secs=F.second(preferred).cast("decimal(8,6)"))
    first = F.when(at <= after, at + F.expr("interval 1 day")).otherwise(at)
    days = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: first + F.make_interval(days=d))
    fits = F.filter(days, lambda t: F.array_contains(weekdays, (F.weekday(F.from_utc_timestamp(t, timezone)) + 1)))
    got = F.when(type_ == "DAILY", daily).when(type_ == "WEEKLY", F.get(fits, F.lit(0)))
    return F.when(got <= until, got)


def first_due(type_: Column, interval: Column, weekdays: Column, timezone: Column, until: Column, preferred: Column, as_of: Column) -> Column:
    """Due time of a new task: the preferred one, but for a WEEKLY rule the first that fits from ``as_of`` on; null
    without a preferred time."""
    weekly = next_occurrence(type_, interval, weekdays, timezone, until, as_of - F.expr("interval 1 millisecond"), preferred)
    return F.when(preferred.isNull(), None).when(type_ == "WEEKLY", weekly).otherwise(preferred)


def lunar_calendar(spark, start: str, days: int, timezone: str) -> DataFrame:
    """``(date, zone, lunar_day)`` of ``days`` days, from the Chinese calendar of the ICU library that comes with Spark;
    a registry of fixed size, made once on the driver."""
    import datetime

    icu = spark._jvm.com.ibm.icu.util
    calendar = icu.ChineseCalendar(icu.TimeZone.getTimeZone(timezone), icu.ULocale("en"))
    first, rows = datetime.datetime.fromisoformat(start).replace(hour=12, tzinfo=datetime.timezone.utc), []
    for k in range(days):
        t = first + datetime.timedelta(days=k)
        calendar.setTimeInMillis(int(t.timestamp() * 1000))
        rows.append((t.date(), timezone, calendar.get(5)))
    return spark.createDataFrame(rows, "date date, zone string, lunar_day int")


def next_lunar(rules: DataFrame, calendar: DataFrame) -> DataFrame:
    """Next listed lunar day of ``rules(rule_id, lunar_days, zone, until, after, preferred)``: for each day of the calendar and
    each lunar day the first date from then on and the one after it are laid out once, so that a rule's listed day meets one row."""
    zones = calendar.groupBy("zone").agg(F.min("date").alias("first"))
    order = Window.partitionBy("zone", "lunar_day").orderBy("date")
    c = calendar.select("zone", "lunar_day", "date").distinct().withColumns({"before": F.lag("date").over(order), "later": F.lead("date").over(order)}).join(F.broadcast(zones), "zone")
    c = c.select("zone", "lunar_day", "date", "later", F.explode(F.sequence(F.coalesce(F.date_add("before", 1), "first"), "date")).alias("day"))
    r = rules.join(F.broadcast(zones), "zone", "left").withColumn("day", F.greatest(F.to_date("after"), "first")).withColumn("lunar_day", F.explode_outer("lunar_days"))
    r = r.join(F.broadcast(c), ["zone", "lunar_day", "day"], "left")
    at = lambda d: F.col(d).cast("timestamp") + F.make_interval(hours=F.hour("preferred"), mins=F.minute("preferred"))
    later = lambda d: F.when(at(d) > F.col("after"), at(d))
    r = r.withColumn("next_at", F.coalesce(later("date"), later("later")))
    r = r.groupBy("rule_id").agg(F.min("next_at").alias("next_at"), F.min(F.when(F.col("next_at").isNotNull(), F.col("until"))).alias("until"))
    return r.select("rule_id", F.when(F.col("next_at") <= F.col("until"), F.col("next_at")).alias("next_at"))


def complete_and_advance(tasks: DataFrame) -> DataFrame:
    """A finished recurring task returns to TODO at its next time with the next sequence number; others stay."""
    nxt = next_occurrence(*[F.col(c) for c in ("recurrence_type", "recurrence_interval", "weekdays", "timezone", "until", "due_at", "due_at")])
    t = tasks.withColumn("_next", nxt).withColumn("_go", (F.col("status") == "DONE") & F.col("_next").isNotNull())
    new = {"due_at": F.col("_next"), "sequence": F.col("sequence") + 1, "status": F.lit("TODO")}
    return t.select(*[F.when(F.col("_go"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in tasks.columns])
