"""Tables as the queries want them: redelivered rows folded, stand-in scores attached."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidwork.session import table

C = "repo_id, cross_repo_split, commit_index, commit_sha, commit_timestamp, in_repo_split, n_new_assertions"
Q = "qna_id, repo_id, cross_repo_split, commit_index, commit_sha, in_repo_split, test_file, lineno, col_offset, assertion_type, test_function, assertion_event_id"

# The same tables for DuckDB, as common table expressions.
SQL_C = f"c as (select distinct {C} from commits)"
SQL_Q = f"q as (select distinct {Q} from qna_pairs)"
SQL_T = "t as (select distinct qna_id, repo_id, commit_sha, in_repo_split, assertion_type, test_function, prefix, target from qna_pairs)"
SQL_S = "s as (select qna_id, repo_id, commit_sha, commit_index, assertion_type, cross_repo_split, lineno % 2 as em, (lineno % 100) / 100.0::double as es, case when lineno % 3 = 0 then 'alpha' when lineno % 3 = 1 then 'beta' else 'gamma' end as method from q)"


def commits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "commits").select(*C.split(", ")).distinct()


def qna(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qna_pairs").select(*Q.split(", ")).distinct()


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Wide text columns; folded by id, so that text is shuffled once."""
    return table(spark, d, "qna_pairs").select("qna_id", "repo_id", "commit_sha", "in_repo_split", "assertion_type", "test_function", "prefix", "target").dropDuplicates(["qna_id"])


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in per-row metrics, derived from line numbers: the tables hold no model output."""
    method = F.when(F.col("lineno") % 3 == 0, "alpha").when(F.col("lineno") % 3 == 1, "beta").otherwise("gamma")
    return qna(spark, d).select("qna_id", "repo_id", "commit_sha", "commit_index", "assertion_type", "cross_repo_split", (F.col("lineno") % 2).alias("em"), ((F.col("lineno") % 100) / F.lit(100.0)).alias("es"), method.alias("method"))
