"""Who may see what: every read is filtered by workspace and principals before anything is ranked or counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVERYONE = "group:all"
MAX_K = 100


@dataclass(frozen=True)
class Caller:
    """An authenticated reader: the workspaces and principals that are theirs."""

    workspaces: tuple[str, ...]
    principals: tuple[str, ...]
    source_type: str = "agent"

    def check_workspace(self, workspace: str) -> None:
        if workspace not in self.workspaces:
            raise PermissionError(f"no access to workspace {workspace}")

    def narrowed(self, principals: list[str]) -> list[str]:
        """Those of the asked principals that the caller owns; none is an error."""
        own = [p for p in principals if p in self.principals]
        if not own:
            raise PermissionError("none of these principals is the caller's")
        return own


def clamp_k(k: int) -> int:
    return max(1, min(MAX_K, k))


def overlaps(column: str, principals: list[str]) -> Column:
    """An array test against a literal, so that it filters the scan; a null or empty list is seen by no one."""
    return F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, principals))), F.lit(False))


def visible(df: DataFrame, workspace: str | None, principals: list[str], column: str = "allowed_principals") -> DataFrame:
    seen = df.where(overlaps(column, principals))
    return seen if workspace is None else seen.where(F.col("workspace") == workspace)


def or_everyone(principals: Column) -> Column:
    """An empty list of principals stands for everyone."""
    return F.when(F.coalesce(F.size(principals), F.lit(0)) > 0, principals).otherwise(F.array(F.lit(EVERYONE)))


def scopes(users: DataFrame, workspaces: list[str], principals: list[str]) -> DataFrame:
    """users with what they own of the asked workspaces and principals; those who own none of either are left out."""
    both = lambda c, asked: F.array_sort(F.array_intersect(c, F.array(*map(F.lit, asked))))
    cut = users.withColumns({"workspaces": both("workspaces", workspaces), "principals": both("principals", principals)})
    return cut.where((F.size("workspaces") > 0) & (F.size("principals") > 0))


def authenticate(users: DataFrame, token: str) -> DataFrame:
    """The user row whose stored sha256 is that of the bearer token."""
    return users.where(F.col("token_hash") == F.sha2(F.lit(token), 256))


def create_user(email: str, token: str, principals: list[str], workspaces: list[str], spark, source_type: str = "human") -> DataFrame:
    """A row for the users table; only the hash of the token is kept."""
    row = spark.range(1).select(F.lit(email).alias("email"), F.sha2(F.lit(token), 256).alias("token_hash"))
    texts = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    return row.withColumns({"principals": texts(principals), "workspaces": texts(workspaces), "source_type": F.lit(source_type)})
