"""Queries of incremental work: batch forms, and streams run over the given tables to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from waystone.operators import reconcile
from waystone.operators.storage import shared_dir
from waystone.plans.q_tracks import hav
from waystone.plans.registry import query
from waystone.streaming import streams


def scratch(t) -> str:
    return f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"


def stream_of(t, name: str):
    """A table of the folder as a stream of files."""
    return t.spark.readStream.schema(t(name).schema).parquet(f"{t.sf_dir}/{name}.parquet*")  # a pattern, as the table can be one file


STANDING = "select k, arg_max(seq, seq) as seq, arg_max(payload, seq) as payload from fx_change group by 1 having arg_max(op, seq) <> 'D'"
PROBLEMS = """select k, seq, case when op = 'N' and there then 'insert-of-existing' when op = 'R' and not there then 'replace-of-missing' when op = 'D' and not there then 'delete-of-missing' end as problem
from (select *, coalesce(lag(op) over (partition by k order by seq) <> 'D', false) as there from fx_change) x where (op = 'N') = there"""


@query("o10_1_change_log", STANDING)
def change_log(t):
    return streams.change_log(t("fx_change"))[0]


@query("o10_1_illegal_changes", PROBLEMS)
def illegal_changes(t):
    return streams.change_log(t("fx_change"))[1]


@query("o10_1_change_log_stream", PROBLEMS)
def change_log_on_a_stream(t):
    o = stream_of(t, "orders")
    op = F.when(F.col("o_orderstatus") == "F", "N").when(F.col("o_orderstatus") == "O", "R").otherwise("D")
    changes = o.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), op.alias("op"), F.col("o_totalprice").alias("payload"))
    out = streams.run_once(streams.change_log_stream(changes), scratch(t))
    return out.where("problem is not null").select("k", "seq", "problem")


@query("o10_2_resume", "select o_orderkey as item from orders where not (o_orderkey % 3 = 0 and o_orderkey % 30 <> 0)")
def resume(t):
    """Planned items that no completed result with the same input covers; every tenth result was made of another input."""
    plan = t("orders").select(F.col("o_orderkey").alias("item"), F.sha2(F.concat_ws("|", "o_orderkey", "o_totalprice"), 256).alias("input"))
    done = t("orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("item"), F.sha2(F.concat_ws("|", "o_orderkey", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 30 == 0, 1.0).otherwise(0.0)), 256).alias("input"))
    return reconcile.to_resume(plan, done, ["item", "input"]).select("item")


@query("o10_3_cleaned_track_stream", f"""with recursive p as (select track_id, epoch(ts) as s, strftime(ts, '%Y-%m-%d %H:%M:%S') as seen, lon, lat, row_number() over (partition by track_id order by ts) as r from fx_track_pt),
walk as (select track_id, r, seen, s as s1, lon as lon1, lat as lat1, true as kept from p where r = 1 union all
select p.track_id, p.r, p.seen, case when keep then p.s else s1 end, case when keep then p.lon else lon1 end, case when keep then p.lat else lat1 end, keep from (select p.*, w.s1, w.lon1, w.lat1, not (p.s - w.s1 <= 86400.0 and {hav('w.lon1', 'w.lat1', 'p.lon', 'p.lat')} <= 300.0) as keep from walk w join p on p.track_id = w.track_id and p.r = w.r + 1) p)
select track_id, seen, round(lon1, 9) as lon, round(lat1, 9) as lat from walk where kept""")
def cleaned_track_stream(t):
    e = stream_of(t, "events")
    u = F.col("user_id")
    points = e.select(u.alias("track_id"), F.col("ts").cast("timestamp").alias("ts"), (-3.0 + (u % 50) * 0.1 + ((F.col("event_id") * 131) % 1000) / 100000.0).alias("lon"), (51.0 + (u % 30) * 0.1 + ((F.col("event_id") * 197) % 1000) / 100000.0).alias("lat"))
    out = streams.run_once(streams.cleaned_stream(points, 300.0, 86400.0), scratch(t))
    return out.select("track_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen"), F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"))


@query("o10_4_tumbling_counts", "select user_id, count(*) as events, round(sum(value), 4) as value, strftime(time_bucket(interval '1 day', ts), '%Y-%m-%d') as day from events group by 1, 4")
def tumbling_counts(t):
    w = streams.window_counts(t("events"), "user_id", "1 day")
    return w.select("user_id", "events", F.round("value", 4).alias("value"), F.date_format("start", "yyyy-MM-dd").alias("day"))


@query("o10_4_sliding_counts", "select event_type, count(*) as events, strftime(s, '%Y-%m-%d %H') as start from (select event_type, unnest([date_trunc('day', ts) + interval '12 hour' * case when extract(hour from ts) >= 12 then 1 else 0 end, date_trunc('day', ts) + interval '12 hour' * case when extract(hour from ts) >= 12 then 0 else -1 end]) as s from events) x group by 1, 3")
def sliding_counts(t):
    return streams.window_counts(t("events"), "event_type", "24 hours", "12 hours").select("event_type", "events", F.date_format("start", "yyyy-MM-dd HH").alias("start"))


@query("o10_4_sessions", """with m as (select user_id, ts, case when epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts)) < 86400000000 then 0 else 1 end as new from events), r as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as run from m)
select user_id, count(*) as events, strftime(min(ts), '%Y-%m-%d %H:%M') as start from r group by user_id, run""")
def sessions(t):
    return streams.session_counts(t("events"), "user_id", "24 hours").select("user_id", "events", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"))
