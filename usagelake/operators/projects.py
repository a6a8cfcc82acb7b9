"""Project resolution, per-project answers and folding of sub-directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelake.contract import DEFAULT_IDLE_MS, TAIL_MS, EventFilters, Tables
from usagelake.operators.active import active_time
from usagelake.operators.filters import apply_filters, prune
from usagelake.operators.totals import count_if

# Fixed value: how many parent directories are searched for a repository root.


def ancestors(path: Column, include_self: bool) -> Column:
    """Every proper ancestor directory of a path, shortest first, optionally with the path."""
    parts = F.split(path, "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - (0 if include_self else 1), F.lit(1))),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    wanted = F.filter(prefixes, lambda p: (p != "") & (F.lit(include_self) | (p != path)))
    return F.array_distinct(wanted)


def resolve_roots(directories: DataFrame, repo_roots: DataFrame) -> DataFrame:
    """Nearest enclosing repository root of each working directory.

    ``directories(working_directory)`` and ``repo_roots(path, git_remote)``. Joining on exploded
    ancestors is an equi-join on exact paths rather than a prefix comparison of every pair.
    A directory outside any repository, or written for another operating system, is its own root.
    """
    dirs = directories.select("working_directory").where(
        F.coalesce(F.col("working_directory"), F.lit("")) != ""
    ).distinct()
    walkable = F.col("working_directory").startswith("/")
    chain = F.reverse(ancestors(F.col("working_directory"), True))
    climbed = dirs.select(
        "working_directory",
        F.explode_outer(F.when(walkable, chain)).alias("path"),
    )
    roots = repo_roots.select("path", "git_remote", F.lit(True).alias("is_root"))
    found = climbed.join(roots, "path", "left")
    hit = F.when(F.col("is_root"), F.length("path"))
    return found.groupBy("working_directory").agg(
        F.coalesce(F.max_by("path", hit), F.col("working_directory")).alias("project_path"),
        F.max_by("git_remote", hit).alias("git_remote"),
    )


def merge_projects(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert of project rows: newest name, known repository kept, sighting span widened."""
    columns = ["project_id", "path", "name", "repository", "git_remote", "first_seen_ms",
               "last_seen_ms"]
    both = stored.select(*columns, F.lit(0).alias("seq")).unionByName(
        incoming.select(*columns, F.lit(1).alias("seq"))
    )

    def newest_known(column: str) -> Column:
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("seq"))).alias(column)

    return both.groupBy("project_id").agg(
        F.min_by("path", "seq").alias("path"),
        F.max_by("name", "seq").alias("name"),
        newest_known("repository"),
        newest_known("git_remote"),
        F.min("first_seen_ms").alias("first_seen_ms"),
        F.max("last_seen_ms").alias("last_seen_ms"),
    )


def project_details(
    tables: Tables, f: EventFilters | None = None, limit: int | None = None,
    idle_ms: int = DEFAULT_IDLE_MS, tail_ms: int = TAIL_MS,
) -> DataFrame:
    """Prompts, sessions, last activity and active time per project of the slice.

    Active time follows the events of that project only, as if the project were filtered on.
    """
    sliced = apply_filters(tables, f).where(F.col("project_id").isNotNull())
    folded = sliced.groupBy("project_id", "session_id").agg(
        count_if("prompt").alias("prompts"), F.max("ts_ms").alias("last_ms")
    )
    counted = folded.groupBy("project_id").agg(
        F.sum("prompts").alias("prompts"),
        F.count("session_id").alias("sessions"),
        F.max("last_ms").alias("last_activity_ms"),
    )
    page = counted.join(
        tables.projects.select("project_id", "name", "path", "repository"), "project_id"
    )
    if limit is not None:
        page = page.orderBy(F.desc("prompts"), "project_id").limit(limit)
    active = active_time(sliced, ["project_id"], ["project_id"], idle_ms, tail_ms).select(
        "project_id", "active_ms"
    )
    out = page.join(active, "project_id", "left").select(
        "project_id", "name", "path", "repository", "prompts", "sessions",
        F.coalesce("active_ms", F.lit(0)).alias("active_ms"), "last_activity_ms",
    )
    return out if limit is None else out.orderBy(F.desc("prompts"), "project_id")


def top_per_project(
    tables: Tables, dimension: str, f: EventFilters | None = None, top_n: int = 5
) -> DataFrame:
    """The most frequent categories, technologies or models of each project in the slice."""
    tables = prune(tables, f)
    sliced = apply_filters(tables, f).where(F.col("project_id").isNotNull())
    if dimension == "category":
        keyed = sliced.select("event_id", "project_id").join(
            tables.classifications.select("event_id", F.col("category").alias("key")), "event_id"
        )
    elif dimension == "technology":
        keyed = sliced.select("event_id", "project_id").join(
            tables.technologies.select("event_id", F.col("technology").alias("key")), "event_id"
        )
    elif dimension == "model":
        keyed = sliced.where(F.col("model").isNotNull()).select(
            "project_id", F.col("model").alias("key")
        )
    else:
        raise ValueError(f"unknown dimension {dimension!r}")
    counted = keyed.groupBy("project_id", "key").agg(F.count(F.lit(1)).alias("count"))
    rank = Window.partitionBy("project_id").orderBy(F.desc("count"), "key")
    return counted.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= top_n)


def project_usage(
    tables: Tables, f: EventFilters | None = None, limit: int | None = None,
    idle_ms: int = DEFAULT_IDLE_MS, tail_ms: int = TAIL_MS,
) -> DataFrame:
    """Project table with its top categories, technologies and models as lists."""
    out = project_details(tables, f, limit, idle_ms, tail_ms)
    for dimension, name in (
        ("category", "top_categories"), ("technology", "top_technologies"), ("model", "top_models")
    ):
        best = (
            top_per_project(tables, dimension, f)
            .groupBy("project_id")
            .agg(F.array_sort(F.collect_list(F.struct("place", "key", "count"))).alias(name))
        )
        out = out.join(best, "project_id", "left")
    return out


def nearest_parents(projects: DataFrame) -> DataFrame:
    """Longest project path that strictly contains each project's path, with the nesting depth."""
    paths = projects.select("project_id", "path").where(F.coalesce("path", F.lit("")) != "")
    climbed = paths.select(
        "project_id", F.explode(ancestors(F.col("path"), False)).alias("ancestor")
    )
    known = paths.select(
        F.col("project_id").alias("parent_id"), F.col("path").alias("ancestor")
    )
    return climbed.join(known, "ancestor").groupBy("project_id").agg(
        F.max_by("parent_id", F.length("ancestor")).alias("parent_id"),
        F.max(F.struct(F.length("ancestor").alias("n"), "ancestor"))["ancestor"].alias(
            "parent_path"
        ),
        F.count(F.lit(1)).alias("depth"),
    )


def fold_subdirectories(usage: DataFrame) -> DataFrame:
    """Sub-directory projects folded into the project around them.

    ``usage(project_id, name, path, prompts, sessions, active_ms, last_activity_ms)``. A project
    directly inside a kept one is folded into it; one directly inside a folded one is kept, so
    nesting alternates and the owner follows from the number of enclosing projects.
    """
    parents = nearest_parents(usage).select("project_id", "parent_id", "depth")
    placed = usage.join(parents, "project_id", "left").withColumn(
        "owner",
        F.when(F.coalesce("depth", F.lit(0)) % 2 == 1, F.col("parent_id")).otherwise(
            F.col("project_id")
        ),
    )
    own = F.col("owner") == F.col("project_id")
    return placed.groupBy(F.col("owner").alias("project_id")).agg(
        F.max(F.when(own, F.col("name"))).alias("name"),
        F.max(F.when(own, F.col("path"))).alias("path"),
        F.sum("prompts").alias("prompts"),
        F.sum("sessions").alias("sessions"),
        F.sum("active_ms").alias("active_ms"),
        F.max("last_activity_ms").alias("last_activity_ms"),
        F.count(F.when(~own, 1)).alias("children"),
    )


SORTS = {
    "name": F.asc, "active_ms": F.desc, "prompts": F.desc, "sessions": F.desc,
    "last_activity_ms": F.desc,
}


def sorted_projects(usage: DataFrame, by: str = "active_ms", quiet: bool = False) -> DataFrame:
    """Project table in the chosen order; projects nobody prompted in are set aside."""
    rows = usage.where(F.col("prompts") == 0 if quiet else F.col("prompts") > 0)
    return rows.orderBy(SORTS[by](by), "project_id")
