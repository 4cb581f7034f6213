"""Splits, anchors and decay curves over time lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.operators import windows
from braidwork.session import table


def split_anchor_decay(spark: SparkSession, d: str) -> DataFrame:
    """Split each user's events, anchor at the last train event, weigh values by distance."""
    rows = windows.chronological_split(table(spark, d, "events").select("user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"])
    anchors = rows.where("split = 'train'").groupBy("user_id").agg(F.max("commit_index").alias("anchor_index"))
    far = F.col("commit_index") - F.col("anchor_index")
    bucket = F.when(far <= 0, "<=anchor").when(far < 3, "1..2").when(far < 6, "3..5").when(far < 10, "6..9").otherwise("10+")
    joined = rows.join(anchors, "user_id").withColumn("bucket", bucket)
    return joined.groupBy("bucket").agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_repos"), F.round(F.avg("value"), 6).alias("mean_value"))


QUERIES = {"w_split_anchor_decay": split_anchor_decay}

ORACLE = {
    "w_split_anchor_decay": """
        with r as (select user_id, event_id, value, row_number() over (partition by user_id order by ts, event_id) as rn, count(*) over (partition by user_id) as n from events),
        s as (select *, greatest(1, floor(n * 0.8::double)) as t0, greatest(1, floor(n * 0.1::double)) as v from r),
        l as (select *, case when n < 3 then 'train' when rn <= t then 'train' when rn <= t + v then 'val' else 'test' end as split
              from (select *, case when t0 + v >= n then greatest(1, t0 - 1) else t0 end as t from s)),
        a as (select user_id, max(rn) as anchor from l where split = 'train' group by user_id),
        b as (select l.user_id, l.value, l.rn - a.anchor as far from l join a using (user_id))
        select case when far <= 0 then '<=anchor' when far < 3 then '1..2' when far < 6 then '3..5' when far < 10 then '6..9' else '10+' end as bucket,
               count(*) as n_rows, count(distinct user_id) as n_repos, round(avg(value), 6) as mean_value from b group by 1""",
}
