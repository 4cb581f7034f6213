"""Schemas of the tables and tolerant reading (1.1-1.3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMITS = "repo_id string, cross_repo_split string, commit_index int, commit_sha string, commit_timestamp string, in_repo_split string, production_code_diff string, n_new_assertions int"
QNA = "repo_id string, cross_repo_split string, commit_index int, commit_sha string, in_repo_split string, test_file string, lineno int, col_offset int, assertion_type string, test_function string, prefix string, target string"
MANIFEST = "repo_id string, commit_sha string, commit_index int, role string, anchor_sha string, anchor_index int, n_commits_after_anchor int"
MINED = "full_name string, html_url string, description string, stars int, forks_count int, size_kb int, language string, license string, created_at string, pushed_at string, updated_at string, default_branch string, archived boolean, is_fork boolean, topics array<string>"
PAIR = "prefix string, target string, assertion_type string, difficulty string, context_lines int"
SPLIT_FILE = f"repositories map<string, struct<embedding: array<double>, qna_pairs: array<struct<{', '.join(p.replace(' ', ': ', 1) for p in PAIR.split(', '))}>>>>"
SHARD_FILE = "finalized boolean, shard_i int, num_shards int, per_commit array<struct<repo_id: string, commit_sha: string, commit_index: int, n_qnas: int, exact_match: double, edit_similarity: double, code_bleu: double>>, raw_samples struct<exact_match: array<double>, edit_similarity: array<double>, code_bleu: array<double>>"
# What an absent optional column holds.
OPTIONAL = {"assertion_event_id": "", "task": "assert_rhs", "test_function": "", "n_added_assertions": 0, "n_modified_assertions": 0, "anchor_index": -1}


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def with_defaults(df: DataFrame, defaults: dict[str, object] = OPTIONAL) -> DataFrame:
    """Absent columns are added, nulls in present ones filled."""
    have = set(df.columns)
    filled = {c: F.coalesce(F.col(c), F.lit(v)) if c in have else F.lit(v) for c, v in defaults.items()}
    return df.withColumns(filled)


def known_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    """The wanted columns that are there, in the wanted order."""
    return df.select(*(c for c in wanted if c in df.columns))


def equality_filter(**conditions: object) -> Column:
    """A conjunction; lists mean `in`, a leading '!' means `not`, None no condition."""
    out = F.lit(True)
    for column, value in conditions.items():
        if value is None:
            continue
        if isinstance(value, (list, tuple, set)):
            out = out & F.col(column).isin(*value)
        elif isinstance(value, str) and value.startswith("!"):
            out = out & (F.col(column) != value[1:])
        elif isinstance(value, (str, int, float, bool)):
            out = out & (F.col(column) == value)
        else:
            raise TypeError(f"{column}: {type(value).__name__} can't be compared")
    return out
