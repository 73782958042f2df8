"""Counters that expire and breakers that open, probe and recover: state that jumps from event to event.

Where the next state begins depends only on the event where this one began, so every
event can say beforehand where the next beginning would lie if one lay on it.  The real
beginnings are then what the first one leads to: found by pointer doubling, in as many
rounds as the logarithm of the longest chain, whatever the skew of keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.operators.events import audit
from vellum.sources import views as V
from vellum.sources.kept import kept

RUN, COOL_SECONDS = 3, 7200


def orbit(hops: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, at): all places that ``starts`` (keys, at) lead to by ``hops`` (keys, at, to), which go forward; the starts too."""
    hops = kept(hops.select(*keys, "at", "to").where("to is not null"))
    marked = starts.select(*keys, "at")
    while not hops.isEmpty():
        marked = kept(marked.unionByName(marked.join(hops, [*keys, "at"]).select(*keys, F.col("to").alias("at"))))
        then = hops.select(*keys, F.col("at").alias("to"), F.col("to").alias("__to"))
        hops = kept(hops.join(then, [*keys, "to"]).select(*keys, "at", F.col("__to").alias("to")))
    return marked


def _numbered(log: DataFrame, seconds: int, keys: list[str]) -> tuple[DataFrame, Window]:
    """``log`` with ``at``, its place from 1, and ``after``, the place of the first event ``seconds`` later or more, which may lie beyond the end."""
    order = Window.partitionBy(*keys).orderBy("us", "seq")
    reach = Window.partitionBy(*keys).orderBy("us").rangeBetween(Window.unboundedPreceding, seconds * 1_000_000 - 1)
    return log.withColumn("at", F.row_number().over(order).cast("long")).withColumn("after", F.count("*").over(reach) + 1), order


def expiring_counts(log: DataFrame, seconds: int, keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """(keys, seq, us, start_us, n): the count that each event of a log (keys, seq, us) brings its key's counter to.

    The first event sets the counter to 1 and its time to live; events at that time or
    later begin anew.  Events of one microsecond count in the order of seq.
    """
    keys = list(keys)
    e, order = _numbered(log.select(*keys, "seq", "us"), seconds, keys)
    e = kept(e)
    starts = orbit(e.select(*keys, "at", F.col("after").alias("to")), e.where("at = 1"), keys)
    e = e.join(starts.withColumn("start", F.lit(True)), [*keys, "at"], "left")
    first = F.last(F.when(F.col("start"), F.struct("at", "us")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return e.withColumn("first", first).select(*keys, "seq", "us", F.col("first.us").alias("start_us"), (F.col("at") - F.col("first.at") + 1).alias("n"))


def openings(log: DataFrame, run: int = RUN, seconds: int = COOL_SECONDS, keys: tuple[str, ...] = ("user_id", "model")) -> DataFrame:
    """(keys, seq, us, reopened, probe_seq, probe_us, recovered): each time a breaker opens, of a log (keys, seq, us, ok).

    It opens at the ``run``-th failure in a row.  The first event ``seconds`` later or more
    probes: a success closes it, and counting starts again behind it; a failure opens
    it anew.  Events before that aren't let through.  Without a probe its columns are null.
    """
    keys = list(keys)
    e, order = _numbered(log.select(*keys, "seq", "us", "ok"), seconds, keys)
    fails = F.sum((~F.col("ok")).cast("int")).over(order.rowsBetween(1 - run, 0))
    e = e.withColumn("falls", (fails == run) & (F.col("at") >= run))
    e = kept(e.withColumn("next", F.min(F.when(F.col("falls"), F.col("at"))).over(order.rowsBetween(run, Window.unboundedFollowing))))
    probe = e.select(*keys, F.col("at").alias("after"), F.col("seq").alias("probe_seq"), F.col("us").alias("probe_us"), F.col("ok").alias("recovered"), "next")
    # an event can only begin an open state if it is a failure
    e = kept(e.where(~F.col("ok")).select(*keys, "at", "seq", "us", "after", "falls").join(probe, [*keys, "after"], "left"))
    to = F.when(F.col("recovered"), F.col("next")).when(~F.col("recovered"), F.col("after"))
    first = e.where("falls").groupBy(*keys).agg(F.min("at").alias("at"))
    opened = orbit(e.select(*keys, "at", to.alias("to")), first, keys)
    again = e.join(opened, [*keys, "at"]).withColumn("before", F.lag("recovered").over(order))
    return again.select(*keys, "seq", "us", F.coalesce(~F.col("before"), F.lit(False)).alias("reopened"), "probe_seq", "probe_us", "recovered")


def failovers(opened: DataFrame, models: tuple[str, ...], keys: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """``opened`` (keys, model, seq, us, probe_us, recovered) with ``to_model``: the first of ``models`` whose breaker isn't open then, or else the first of all."""
    keys = list(keys)
    up_at = F.when(F.col("recovered"), F.col("probe_us"))
    told = opened.select(*keys, "model", "us", "seq", F.lit(0).alias("kind"), F.struct(up_at.alias("up_at")).alias("state"), F.lit(None).cast("string").alias("of"))
    each = F.explode(F.array(*map(F.lit, models)))
    asked = opened.select(*keys, each.alias("m"), "us", "seq", F.lit(1).alias("kind"), F.lit(None).cast(told.schema["state"].dataType).alias("state"), F.col("model").alias("of")).withColumnRenamed("m", "model")
    order = Window.partitionBy(*keys, "model").orderBy("us", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    state = F.last("state", ignorenulls=True).over(order)
    seen = told.unionByName(asked).withColumn("now", state).where("kind = 1")
    up = F.col("now").isNull() | (F.col("now.up_at") <= F.col("us"))
    place = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    to = seen.where(up & (F.col("model") != F.col("of"))).groupBy(*keys, F.col("of").alias("model"), "seq").agg(F.min_by("model", place).alias("to_model"))
    return opened.join(to, [*keys, "model", "seq"], "left").withColumn("to_model", F.coalesce("to_model", F.lit(models[0])))


def resolved_sessions(touches: DataFrame, seconds: int) -> DataFrame:
    """``touches`` (token, seq, us) with ``valid``: whether the token's session still stands then.

    The first touch begins it, each one that finds it keeps it up.  One that comes more than
    ``seconds`` after the last ends it, and no later one finds it again.
    """
    order = Window.partitionBy("token").orderBy("us", "seq")
    late = F.coalesce(F.col("us") - F.lag("us").over(order) > seconds * 1_000_000, F.lit(False))
    rows = touches.withColumn("__late", late)
    return rows.withColumn("valid", ~F.max("__late").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__late")


HOURS, MOST, IDLE_HOURS = 12, 3, 24
MODELS = ("click", "error", "purchase", "signup", "view")


def outcomes(spark, d) -> DataFrame:
    """The event log as outcomes of a user's models: values of 40 or more are successes."""
    return audit(V.table(spark, d, "events")).select("user_id", F.col("event_type").alias("model"), "seq", "us", (F.col("value") >= 40).alias("ok"))


def _rates(spark, d) -> DataFrame:
    c = expiring_counts(audit(V.table(spark, d, "events")), HOURS * 3600)
    return c.groupBy("user_id").agg(F.count_distinct("start_us").alias("windows"), F.max("n").alias("most"), F.sum((F.col("n") > MOST).cast("int")).alias("refused"))


def _breakers(spark, d) -> DataFrame:
    return failovers(openings(outcomes(spark, d)), MODELS)


def _sessions(spark, d) -> DataFrame:
    """Each user's events of a day of the week as the touches of one token."""
    token = F.concat("user_id", F.lit(":"), F.dayofweek("ts"))
    r = resolved_sessions(audit(V.table(spark, d, "events")).select(token.alias("token"), "seq", "us"), IDLE_HOURS * 3600)
    return r.groupBy("token").agg(F.count("*").alias("touches"), F.sum(F.col("valid").cast("int")).alias("valid"), F.min(F.when(~F.col("valid"), F.col("us"))).alias("ended_us"))


QUERIES = {"expiring_limit": _rates, "breaker_failover": _breakers, "token_sessions": _sessions}

ORACLE_SQL = {
    "token_sessions": f"""with t as (select user_id || ':' || (dayofweek(ts) + 1) as token, event_id as seq, epoch_us(ts) as us from events),
l as (select *, coalesce(us - lag(us) over (partition by token order by us, seq) > {IDLE_HOURS * 3_600_000_000}, false) as late from t),
v as (select *, not bool_or(late) over (partition by token order by us, seq rows unbounded preceding) as valid from l)
select token, count(*) as touches, count(*) filter (valid) as valid, min(us) filter (not valid) as ended_us from v group by 1""",
    "expiring_limit": f"""with recursive e as (
  select user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as pos,
    count(*) over (partition by user_id order by epoch_us(ts) range between unbounded preceding and {HOURS * 3_600_000_000 - 1} following) + 1 as nxt from events),
s as (select user_id, pos, us, nxt from e where pos = 1 union all select e.user_id, e.pos, e.us, e.nxt from s join e on e.user_id = s.user_id and e.pos = s.nxt),
c as (select e.user_id, s.us as start_us, e.pos - s.pos + 1 as n from e join s on s.user_id = e.user_id and e.pos >= s.pos and e.pos < s.nxt)
select user_id, count(distinct start_us) as windows, max(n) as most, count(*) filter (n > {MOST}) as refused from c group by 1""",
    "breaker_failover": f"""with recursive e as (
  select user_id, event_type as model, event_id as seq, epoch_us(ts) as us, value >= 40 as ok, row_number() over w as pos,
    count(*) over (partition by user_id, event_type order by epoch_us(ts) range between unbounded preceding and {COOL_SECONDS * 1_000_000 - 1} following) + 1 as after,
    count(*) filter (value < 40) over (partition by user_id, event_type order by ts, event_id rows between {RUN - 1} preceding and current row) = {RUN} as falls
  from events window w as (partition by user_id, event_type order by ts, event_id)),
n as (select a.*, p.seq as probe_seq, p.us as probe_us, p.ok as recovered,
    case when p.ok then (select min(k.pos) from e k where k.user_id = a.user_id and k.model = a.model and k.falls and k.pos >= p.pos + {RUN}) when not p.ok then p.pos end as nxt
  from e a left join e p on p.user_id = a.user_id and p.model = a.model and p.pos = a.after where not a.ok),
o as (
  select n.*, false as reopened from n where falls and pos = (select min(k.pos) from e k where k.falls and k.user_id = n.user_id and k.model = n.model)
  union all select n.*, not o.recovered from o join n on n.user_id = o.user_id and n.model = o.model and n.pos = o.nxt),
m as (select o.user_id, o.model, o.seq, min(k.m) as to_model from o, (values {", ".join(f"('{m}')" for m in MODELS)}) k(m)
  where k.m <> o.model and coalesce((select case when recovered then probe_us <= o.us else false end from o x where x.user_id = o.user_id and x.model = k.m and x.us <= o.us order by x.us desc, x.seq desc limit 1), true)
  group by all)
select o.user_id, o.model, o.seq, o.us, o.reopened, o.probe_seq, o.probe_us, o.recovered, coalesce(to_model, '{MODELS[0]}') as to_model from o left join m using (user_id, model, seq)""",
}
