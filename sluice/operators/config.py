"""Configuration resolution: objects, settings, connections, metadata, id lookups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.joins import join_per_key
from sluice.functions.lists import explode_list

DEFAULT_PIPELINE = "default"


def active_objects(cfg: DataFrame, pipeline_id: str | None = None) -> DataFrame:
    """Active source objects (of one pipeline or all) in load order."""
    q = cfg.filter(F.col("active_flag"))
    if pipeline_id is not None:
        q = q.filter(F.col("pipeline_id") == pipeline_id)
    return q.orderBy("pipeline_id", "load_order", "object_id")


def latest_per_key(df: DataFrame, keys: Sequence[str], value_col: str, order_cols: Sequence[str]) -> DataFrame:
    """One value per key: the one with the greatest ``order_cols``.

    ``max_by`` is a partial aggregate, so a key with many versions is
    reduced per task before the shuffle.
    """
    order = F.struct(*[F.col(c) for c in order_cols]) if len(order_cols) > 1 else F.col(order_cols[0])
    return df.groupBy(*keys).agg(F.max_by(value_col, order).alias(value_col))


def pipeline_settings(cfg: DataFrame, types: Mapping[str, str], order_cols: Sequence[str] = (),
                      key_col: str = "config_key", value_col: str = "config_value",
                      group_col: str = "pipeline_id") -> DataFrame:
    """Active key-value settings pivoted to one typed column per key.

    Values are text in the table; each is ``try_cast`` to its declared type,
    so a bad value reads as NULL instead of failing the run.  With
    ``order_cols`` the latest version of a key wins.
    """
    active = cfg.filter(F.col("active_flag")) if "active_flag" in cfg.columns else cfg
    keys = list(types)
    active = active.filter(F.col(key_col).isin(keys))
    if order_cols:
        active = latest_per_key(active, [group_col, key_col], value_col, order_cols)
    wide = active.groupBy(group_col).pivot(key_col, keys).agg(F.first(value_col))
    return wide.select(group_col, *[F.col(f"`{k}`").try_cast(t).alias(k) for k, t in types.items()])


def connections_for(objects: DataFrame, connections: DataFrame) -> DataFrame:
    """Each object with its pipeline's active connection for its source system.

    Of several active ones the newest counts (``created_at``, where the table has it), then the least name.
    """
    keys = ["pipeline_id", "source_system"]
    active = connections.filter(F.col("active_flag"))
    info = [c for c in active.columns if c not in (*keys, "active_flag", "created_at", "updated_at")]
    age = -F.unix_micros(F.col("created_at").cast("timestamp")) if "created_at" in active.columns else F.lit(0)
    one = active.groupBy(*keys).agg(F.min_by(F.struct(*info), F.struct(age, "connection_name")).alias("_c"))
    return objects.join(one.select(*keys, "_c.*"), keys, "left")


def effective_metadata(cfg: DataFrame, pipelines: DataFrame, load_type: str | None = None) -> DataFrame:
    """Metadata columns each pipeline gets: ``default`` rows shared, a
    pipeline's own row overriding the default of the same name.

    The override is decided before the active filter, so an inactive
    pipeline row switches the default off.  With ``load_type`` only rows that
    apply to it (``all`` or the type) remain.

    Every pipeline row generates the defaults from one array of them.
    """
    cols = cfg.columns
    keys = ["pipeline_id", "column_name"]
    others = [c for c in cols if c not in keys]
    pipes = pipelines.select("pipeline_id").distinct()
    own = cfg.filter(F.col("pipeline_id") != DEFAULT_PIPELINE).join(pipes, "pipeline_id", "left_semi")
    defaults = cfg.filter(F.col("pipeline_id") == DEFAULT_PIPELINE).drop("pipeline_id")
    inherited = _inherit(pipes, defaults)
    # one aggregate picks, per (pipeline, column), the pipeline's own row over the default
    # (each group holds at most two rows); no second pass over the pipeline rows for an anti-join
    both = own.select(*cols, F.lit(0).alias("_rank")).unionByName(inherited.select(*cols, F.lit(1).alias("_rank")))
    best = both.groupBy(*keys).agg(F.min(F.struct("_rank", *others)).alias("_w"))
    eff = best.select(*keys, *[F.col(f"_w.{c}").alias(c) for c in others]).select(*cols)
    eff = eff.filter(F.col("active_flag"))
    if load_type is not None:
        eff = eff.filter(F.col("applies_to").isin("all", load_type))
    return eff


def _inherit(pipes: DataFrame, defaults: DataFrame) -> DataFrame:
    """Every default for every pipeline: a scalar subquery gives the defaults as one array of config rows."""
    rows = defaults.agg(F.collect_list(F.struct(*defaults.columns)).alias("_d")).scalar()
    return pipes.select("pipeline_id", rows.alias("_d")).select("pipeline_id", F.inline("_d"))


def resolve_ids(rows: DataFrame, lookup: DataFrame, on: Mapping[str, str], id_col: str,
                out_col: str = "object_id", order_cols: Sequence[str] = (),
                drop_on: bool = False) -> tuple[DataFrame, DataFrame]:
    """Attach ``lookup.id_col`` to rows by equi-join on ``on`` (row col -> lookup col).

    Returns ``(resolved, dropped)``: rows without a match are not an error,
    they come back as the second frame for the report.  When the lookup has
    several ids for one key the first by ``order_cols`` (then id) wins;
    that reduction is a partial aggregate.  A lookup row without an id matches nothing, and neither does
    a NULL key, however large the lookup is.
    """
    lkeys = list(on.values())
    order = [F.col(c) for c in order_cols] + [F.col(id_col)]
    usable = lookup.where(F.col(id_col).isNotNull())
    for k in lkeys:
        usable = usable.where(F.col(k).isNotNull())
    per_key = (usable.groupBy(*lkeys).agg(F.min(F.struct(*order)).alias("_w"))
               .select(*[F.col(k).alias(row_key) for row_key, k in on.items()], F.col(f"_w.{id_col}").alias(out_col)))
    joined = join_per_key(rows, per_key, list(on.keys()))
    resolved = joined.filter(F.col(out_col).isNotNull())
    dropped = joined.filter(F.col(out_col).isNull()).drop(out_col)
    if drop_on:
        resolved = resolved.drop(*on.keys())
    return resolved, dropped


def expand_list_column(df: DataFrame, list_col: str, keep: Sequence[str], out_col: str = "column_name",
                       position_col: str | None = "position") -> DataFrame:
    """``primary_key`` / ``hash_columns`` text to one row per column name."""
    return explode_list(df, list_col, keep, out_col=out_col, position_col=position_col)

