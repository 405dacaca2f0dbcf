"""Ledgers, indicators and tasks over the star-schema tables."""

from pyspark.sql import functions as F

from newsloom.operators import ledger as l
from newsloom.plans.views import load

AS_OF = "1998-01-15 00:00:00"
PRIORITY = {"1-URGENT": "URGENT", "2-HIGH": "HIGH", "3-MEDIUM": "MEDIUM"}


def _ledger(spark, d):
    o = load(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "P", "INCOME").otherwise("EXPENSE")
    return o.select(F.col("o_custkey").alias("user_id"), F.to_date(l.month_of(F.col("o_orderdate"))).alias("month"), F.col("o_orderpriority").alias("category"), kind.alias("type"), F.col("o_totalprice").cast("decimal(19,2)").alias("amount"))


def _budgets(spark, d):
    return _ledger(spark, d).where("type = 'INCOME'").groupBy("user_id", "month").agg(F.max("amount").alias("amount"))


def _observations(spark, d):
    i = load(spark, d, "lineitem")
    return i.groupBy(F.concat("l_returnflag", "l_linestatus").alias("key"), F.date_trunc("month", "l_shipdate").alias("observed_at")).agg(F.round(F.sum(F.col("l_extendedprice").cast("decimal(15,2)")).cast("double") / F.count("l_extendedprice") + 1e-7, 2).cast("decimal(20,4)").alias("value"))


def _tasks(spark, d):
    o = load(spark, d, "orders")
    p = F.col("o_orderpriority")
    priority = F.when(p.startswith("1"), "URGENT").when(p.startswith("2"), "HIGH").when(p.startswith("3"), "MEDIUM").otherwise("LOW")
    status = F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "P", "IN_PROGRESS").otherwise("TODO")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("NONE", "DAILY", "WEEKLY")]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("task_id"), priority.alias("priority"), status.alias("status"),
        F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("due_at"), F.col("o_orderdate").alias("created_at"),
        kind.alias("recurrence_type"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("recurrence_interval"), F.array((F.col("o_orderkey") % 7 + 1).cast("int")).alias("weekdays"),
        F.lit("UTC").alias("timezone"), (F.col("o_orderdate") + F.expr("interval 5 days")).alias("until"), F.lit(0).alias("sequence"),
    )


def ledger_totals(spark, d):
    return l.totals(_ledger(spark, d))


def ledger_categories(spark, d):
    return l.by_category(_ledger(spark, d))


def ledger_summary(spark, d):
    """With the expenses by category as one text."""
    s = l.monthly_summary(_ledger(spark, d), _budgets(spark, d))
    text = F.array_join(F.transform("breakdown", lambda x: F.concat_ws("/", x.category, x.amount.cast("string"), x.n.cast("string"))), ",")
    return s.withColumn("breakdown", text)


def months_parsed(spark, d):
    """Months that users ask for, some of them no months."""
    o = load(spark, d, "orders")
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 7 == 0, "1997-13").when(F.col("o_orderkey") % 11 != 0, F.date_format("o_orderdate", "yyyy-MM"))
    return o.select("o_orderkey", l.month_range(raw, F.lit(AS_OF).cast("timestamp")).alias("m")).select("o_orderkey", "m.key", "m.start", "m.end")


def dates_local(spark, d):
    """The date of events in several zones."""
    e = load(spark, d, "events")
    zone = F.element_at(F.array(*[F.lit(z) for z in ("UTC", "Asia/Ho_Chi_Minh", "America/New_York", "Asia/Kathmandu")]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", l.local_date(F.col("ts"), zone).alias("date"))


def ledger_errors(spark, d):
    rows = _ledger(spark, d)
    cats = rows.groupBy("category").agg(F.lit("EXPENSE").alias("type"), (F.col("category") == "5-LOW").alias("archived")).where("category <> '3-MEDIUM'")
    return l.row_errors(rows, cats).groupBy("type", "error").agg(F.count("*").alias("n"))


def indicator_latest(spark, d):
    return l.latest_observations(_observations(spark, d)).select("key", "place", "observed_at", "value")


def indicator_changes(spark, d):
    return l.changes(_observations(spark, d)).select("key", "observed_at", "value", "previous", "change_value", F.round(F.col("change_pct").cast("double"), 6).alias("change_pct"))


def indicator_range(spark, d):
    return l.in_range(_observations(spark, d), "3M", AS_OF)


def tasks_open(spark, d):
    return l.open_tasks(_tasks(spark, d)).select("user_id", "task_id", "priority", "due_at", "place")


def tasks_page(spark, d):
    return l.task_page(_tasks(spark, d), 1, 5).select("user_id", "task_id", "due_at", "total", "place")


def tasks_brief(spark, d):
    return l.task_brief(_tasks(spark, d), AS_OF).select("user_id", "bucket", "task_id", "in_bucket")


def tasks_advanced(spark, d):
    return l.complete_and_advance(_tasks(spark, d)).select("task_id", "status", "due_at", "sequence")


def tasks_rule_errors(spark, d):
    t = _tasks(spark, d)
    e = l.recurrence_errors(F.col("recurrence_type"), F.col("recurrence_interval"), F.when(F.col("task_id") % 2 == 0, F.col("weekdays")), F.lit(None).cast("array<int>"), F.col("created_at"), F.when(F.col("task_id") % 5 != 0, F.col("until")))
    return t.select("task_id", F.array_join(e, ",").alias("errors"))


def tasks_lunar(spark, d):
    """Next first or fifteenth lunar day after each task's date."""
    t = _tasks(spark, d).where("due_at is not null")
    rules = t.select(F.col("task_id").alias("rule_id"), F.array(F.lit(1), F.lit(15)).alias("lunar_days"), F.lit("Asia/Ho_Chi_Minh").alias("zone"), (F.col("due_at") + F.expr("interval 60 days")).alias("until"), F.col("due_at").alias("after"), F.col("due_at").alias("preferred"))
    return l.next_lunar(rules, l.lunar_calendar(spark, "1992-01-01", 4200, "Asia/Ho_Chi_Minh"))


LEDGER = "ledger AS (SELECT o_custkey AS user_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderpriority AS category, CASE WHEN o_orderstatus = 'P' THEN 'INCOME' ELSE 'EXPENSE' END AS type, CAST(o_totalprice AS DECIMAL(19,2)) AS amount FROM orders)"
OBS = "obs AS (SELECT l_returnflag || l_linestatus AS key, date_trunc('month', l_shipdate) AS observed_at, CAST(round(CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) / count(l_extendedprice) + 1e-7::DOUBLE, 2) AS DECIMAL(20,4)) AS value FROM lineitem GROUP BY ALL)"
TASKS = """tasks AS (SELECT o_custkey AS user_id, o_orderkey AS task_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'URGENT' WHEN '2' THEN 'HIGH' WHEN '3' THEN 'MEDIUM' ELSE 'LOW' END AS priority,
  CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'P' THEN 'IN_PROGRESS' ELSE 'TODO' END AS status, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS due_at, o_orderdate AS created_at,
  ['NONE', 'DAILY', 'WEEKLY'][o_orderkey % 3 + 1] AS rtype, CAST(o_orderkey % 4 + 1 AS INT) AS rint, CAST(o_orderkey % 7 + 1 AS INT) AS wd, o_orderdate + INTERVAL 5 DAY AS until FROM orders)"""
OPEN = "open AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE priority WHEN 'URGENT' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, due_at ASC NULLS LAST, task_id) AS place FROM tasks WHERE status IN ('TODO', 'IN_PROGRESS'))"
ORACLE_SQL = {
    "ledger_totals": f"WITH {LEDGER} SELECT user_id, month, type, sum(amount) AS amount, count(*) AS n FROM ledger GROUP BY ALL",
    "ledger_categories": f"WITH {LEDGER} SELECT user_id, month, category, sum(amount) AS amount, count(*) AS n FROM ledger WHERE type = 'EXPENSE' GROUP BY ALL",
    "ledger_summary": f"""WITH {LEDGER}, b AS (SELECT user_id, month, max(amount) AS budget FROM ledger WHERE type = 'INCOME' GROUP BY ALL),
s AS (SELECT user_id, month, coalesce(sum(amount) FILTER (type = 'INCOME'), 0) AS income, coalesce(sum(amount) FILTER (type = 'EXPENSE'), 0) AS expense FROM ledger GROUP BY ALL),
c AS (SELECT user_id, month, category, sum(amount) AS amount, count(*) AS n FROM ledger WHERE type = 'EXPENSE' GROUP BY ALL), k AS (SELECT user_id, month, string_agg(category || '/' || amount || '/' || n, ',' ORDER BY category) AS breakdown FROM c GROUP BY ALL)
SELECT user_id, month, income, expense, coalesce(budget, 0) AS budget, income - expense AS balance, coalesce(budget, 0) - expense AS remaining, coalesce(breakdown, '') AS breakdown FROM s LEFT JOIN b USING (user_id, month) LEFT JOIN k USING (user_id, month)""",
    "months_parsed": """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 7 = 0 THEN '1997-13' WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m') END AS raw FROM orders),
k AS (SELECT o_orderkey, CASE WHEN regexp_full_match(raw, '[0-9]{4}-(0[1-9]|1[0-2])') THEN raw ELSE '1998-01' END AS key FROM r) SELECT o_orderkey, key, CAST(key || '-01' AS TIMESTAMP) AS start, CAST(key || '-01' AS TIMESTAMP) + INTERVAL 1 MONTH AS "end" FROM k""",
    "dates_local": "SELECT event_id, strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE ['UTC', 'Asia/Ho_Chi_Minh', 'America/New_York', 'Asia/Kathmandu'][event_id % 4 + 1], '%Y-%m-%d') AS date FROM events",
    "ledger_errors": f"""WITH {LEDGER} SELECT type, CASE WHEN amount IS NULL OR amount <= 0 THEN 'AMOUNT_INVALID' WHEN category = '3-MEDIUM' THEN 'CATEGORY_NOT_FOUND' WHEN category = '5-LOW' THEN 'CATEGORY_ARCHIVED'
  WHEN type <> 'EXPENSE' THEN 'CATEGORY_TYPE_MISMATCH' END AS error, count(*) AS n FROM ledger GROUP BY ALL""",
    "indicator_latest": f"WITH {OBS} SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY observed_at DESC) AS INT) AS place, observed_at, value FROM obs QUALIFY place <= 2",
    "indicator_changes": f"""WITH {OBS}, p AS (SELECT *, lag(value) OVER (PARTITION BY key ORDER BY observed_at) AS previous FROM obs)
SELECT key, observed_at, value, previous, value - previous AS change_value, round(CASE WHEN previous IS NULL THEN NULL WHEN previous = 0 THEN 0 ELSE CAST(value - previous AS DOUBLE) / CAST(previous AS DOUBLE) * 100 END, 6) AS change_pct FROM p""",
    "indicator_range": f"WITH {OBS} SELECT * FROM obs WHERE observed_at >= TIMESTAMP '{AS_OF}' - INTERVAL 93 DAY",
    "tasks_open": f"WITH {TASKS}, {OPEN} SELECT user_id, task_id, priority, due_at, CAST(place AS INT) AS place FROM open",
    "tasks_page": f"WITH {TASKS} SELECT user_id, task_id, due_at, count(*) OVER (PARTITION BY user_id) AS total, CAST(row_number() OVER (PARTITION BY user_id ORDER BY due_at ASC NULLS LAST, created_at DESC, task_id) AS INT) AS place FROM tasks QUALIFY place <= 5",
    "tasks_brief": f"""WITH {TASKS}, {OPEN}, b AS (SELECT *, CASE WHEN due_at < TIMESTAMP '{AS_OF}' THEN 'overdue' WHEN CAST(due_at AS DATE) = DATE '{AS_OF[:10]}' THEN 'today' ELSE 'upcoming' END AS bucket FROM open)
SELECT user_id, bucket, task_id, CAST(row_number() OVER (PARTITION BY user_id, bucket ORDER BY place) AS INT) AS in_bucket FROM b QUALIFY bucket <> 'upcoming' OR in_bucket <= 5""",
    "tasks_advanced": f"""WITH {TASKS}, n AS (SELECT *, CASE rtype WHEN 'DAILY' THEN due_at + to_days(rint) WHEN 'WEEKLY' THEN due_at + INTERVAL 1 DAY + to_days(CAST((wd - isodow(due_at + INTERVAL 1 DAY) + 7) % 7 AS INT)) END AS nx FROM tasks),
g AS (SELECT *, status = 'DONE' AND nx IS NOT NULL AND nx <= until AS go FROM n)
SELECT task_id, CASE WHEN go THEN 'TODO' ELSE status END AS status, CASE WHEN go THEN nx ELSE due_at END AS due_at, CASE WHEN go THEN 1 ELSE 0 END AS sequence FROM g""",
    "tasks_rule_errors": f"""WITH {TASKS} SELECT task_id, CASE WHEN rtype = 'NONE' THEN '' ELSE array_to_string(list_filter([CASE WHEN task_id % 5 = 0 THEN 'RECURRENCE_END_REQUIRED' END,
  CASE WHEN rtype = 'WEEKLY' AND task_id % 2 <> 0 THEN 'RECURRENCE_WEEKDAY_REQUIRED' END], lambda x: x IS NOT NULL), ',') END AS errors FROM tasks""",
}
QUERIES = {f.__name__: f for f in (ledger_totals, ledger_categories, ledger_summary, months_parsed, dates_local, ledger_errors, indicator_latest, indicator_changes, indicator_range, tasks_open, tasks_page, tasks_brief, tasks_advanced, tasks_rule_errors, tasks_lunar)}
