"""Keyed upserts, deletes and partial updates.

Every operator returns the new state of the table; ``sources.versions`` writes it as a new
version, never over the one being read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.errors import ConfigNotFound
from groundwork.operators.joins import numbered

MATCHED = "__matched"
ACTIVE = "ACTIVE"
DECOMMISSIONED = "DECOMMISSIONED"


def latest_per_key(source: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, the greatest by ``order_by``; an aggregate, so a hot key never gathers."""
    rest = [c for c in source.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(*order_by)).alias("row")
    return source.groupBy(*keys).agg(pick).select(*keys, *[F.col(f"row.`{c}`").alias(c) for c in rest]).select(
        *source.columns
    )


def _fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own size estimate is within its broadcast threshold."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= int(limit)


def _once(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``source``, which fails when it is read if a key without NULLs occurs twice; read in one pass."""
    rest = [c for c in source.columns if c not in keys]
    # Rows without a full key are no duplicates of each other.
    unknown = F.when(F.greatest(F.lit(False), *(F.col(k).isNull() for k in keys)), F.monotonically_increasing_id())
    grouped = source.withColumn("__row", unknown).groupBy(*keys, "__row")
    found = grouped.agg(F.first(F.struct(F.lit(0).alias("__none"), *rest)).alias("__rest"), F.count("*").alias("__n"))
    failure = F.raise_error(F.lit(f"the source holds a key ({', '.join(keys)}) more than once")).cast("boolean")
    single = found.where(F.when(F.col("__n") > 1, failure).otherwise(F.lit(True)))
    return single.select(*[F.col(c) if c in keys else F.col(f"__rest.`{c}`").alias(c) for c in source.columns])


def merge_into(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str],
    defaults: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Target after the merge, in the target's columns.

    Matched rows take ``update_cols`` from the source and keep the rest. Unmatched source rows
    are inserted; a column they lack or hold as NULL takes its default. Target rows absent
    from the source stay. A source that holds a key twice fails the query: see
    :func:`latest_per_key`.

    A source within the broadcast threshold leaves the target unshuffled and reads its keys a second
    time; a larger one costs a single full outer join.
    """
    defaults = dict(defaults or {})
    source = _once(source, keys)
    given = [c for c in target.columns if c in source.columns]
    marked = source.select(*given, F.lit(True).alias(MATCHED))

    def inserted(column: str, value: Column | None) -> Column:
        kind = target.schema[column].dataType
        parts = [v for v in (value, defaults.get(column)) if v is not None]
        return (F.coalesce(*parts) if parts else F.lit(None)).cast(kind)

    def updated(column: str) -> Column:
        return F.when(F.col(f"s.{MATCHED}"), F.col(f"s.{column}").cast(target.schema[column].dataType)).otherwise(
            F.col(f"t.{column}")
        )

    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    if _fits_broadcast(source):
        kept = target.alias("t").join(marked.alias("s"), on, "left").select(
            *[(updated(c) if c in update_cols else F.col(f"t.{c}")).alias(c) for c in target.columns]
        )
        present = target.alias("t").join(source.alias("s"), on, "left_semi").select(*keys)
        fresh = source.join(present, list(keys), "left_anti").select(
            *[inserted(c, F.col(c) if c in given else None).alias(c) for c in target.columns]
        )
        return kept.unionByName(fresh)
    stored = target.withColumn("__stored", F.lit(True))
    merged = []
    for c in target.columns:
        old = updated(c) if c in update_cols else F.col(f"t.{c}")
        new = inserted(c, F.col(f"s.{c}") if c in given else None)
        merged.append(F.when(F.col("t.__stored"), old).otherwise(new).alias(c))
    return stored.alias("t").join(marked.alias("s"), on, "full_outer").select(*merged)


def provision(provisioned: DataFrame, as_of: Column) -> tuple[DataFrame, list[str], dict[str, Column]]:
    """Source, updated columns and defaults of the merge that provisions agents at ``as_of``."""
    source = provisioned.withColumns({"status": F.lit(ACTIVE), "created_at": as_of, "updated_at": as_of})
    described = [c for c in provisioned.columns if c not in ("agent_id", "created_at")]
    update = list(dict.fromkeys([*described, "status", "updated_at"]))
    return source, update, {"deployment_target": F.lit("HYBRID"), "status": F.lit(ACTIVE)}


def catalog_upsert(catalog: DataFrame, provisioned: DataFrame, as_of: Column) -> DataFrame:
    """Provision agents: created_at is kept, updated_at is ``as_of``, every touched agent ACTIVE."""
    source, update, defaults = provision(provisioned, as_of)
    return merge_into(catalog, source, ["agent_id"], update, defaults)


def _flag_ids(df: DataFrame, key: str, ids: DataFrame | Sequence) -> tuple[DataFrame, Column]:
    if isinstance(ids, DataFrame):
        gone = ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn(MATCHED, F.lit(True))
        return df.join(gone, key, "left"), F.coalesce(F.col(MATCHED), F.lit(False))
    return df, F.coalesce(F.col(key).isin(list(ids)), F.lit(False))


def soft_delete(df: DataFrame, key: str, ids: DataFrame | Sequence, as_of: Column) -> DataFrame:
    """Rows of ``ids`` become DECOMMISSIONED at ``as_of``; every row stays."""
    flagged, hit = _flag_ids(df, key, ids)
    return flagged.withColumns(
        {
            "status": F.when(hit, F.lit(DECOMMISSIONED)).otherwise(F.col("status")),
            "updated_at": F.when(hit, as_of).otherwise(F.col("updated_at")),
        }
    ).select(*df.columns)


def cascade_delete(
    parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, ids: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Parent without ``ids`` and child without the rows that refer to them."""
    gone = ids.select(F.col(ids.columns[0]).alias("__gone")).distinct()
    return (
        parent.join(gone, parent[parent_key] == gone["__gone"], "left_anti"),
        child.join(gone, child[child_key] == gone["__gone"], "left_anti"),
    )


def patch(df: DataFrame, changes: DataFrame, key: str, blank_allowed: Sequence[str] = ()) -> DataFrame:
    """Partial update: NULL or '' keeps the old value, but '' is taken for ``blank_allowed``.

    Changes that hold a key twice fail the query.
    """
    changes = _once(changes, [key])
    cols = [c for c in changes.columns if c != key]

    def change(c: str) -> Column:
        new = F.col(f"c.{c}")
        if c not in blank_allowed and df.schema[c].dataType.typeName() == "string":
            new = F.when(new != "", new)
        return F.coalesce(new, F.col(f"d.{c}"))

    return df.alias("d").join(changes.alias("c"), F.col(f"d.{key}") == F.col(f"c.{key}"), "left").select(
        *[(change(c) if c in cols else F.col(f"d.{c}")).alias(c) for c in df.columns]
    )


def lookup(ids: DataFrame, key: str, primary: DataFrame, fallback: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each id's row from ``primary``, else from ``fallback``, else NULLs; ``found_in`` says which."""
    p = primary.select(key, F.struct(*columns).alias("p"))
    f = fallback.select(key, F.struct(*columns).alias("f"))
    joined = ids.select(key).join(p, key, "left").join(f, key, "left")
    row = F.coalesce("p", "f")
    found_in = F.when(F.col("p").isNotNull(), "primary").when(F.col("f").isNotNull(), "fallback")
    return joined.select(key, *[row[c].alias(c) for c in columns], found_in.alias("found_in"))


def config_value(config: DataFrame, agent: str, key: str) -> str:
    """Value stored for (agent, key); raises when there is none."""
    row = config.where((F.col("agent") == agent) & (F.col("key") == key)).select("value").first()
    if row is None:
        raise ConfigNotFound(f"no {key} configured for {agent}")
    return row["value"]


def config_replace(config: DataFrame, given: DataFrame) -> DataFrame:
    """Configuration (id, key, value, agent) after storing (key, agent, value): a stored pair gets the new value, others are added.

    A pair given twice fails; new rows get ids after the largest one, in the order of agent and key.
    """
    last = F.coalesce(config.agg(F.max("id")).scalar(), F.lit(0))
    fresh = given.select("key", "agent").distinct().join(config.select("key", "agent"), ["key", "agent"], "left_anti")
    placed = numbered(fresh, F.col("agent"), F.col("key"))
    ids = placed.select("key", "agent", (last + F.col("position")).cast(config.schema["id"].dataType).alias("id"))
    source = given.join(ids, ["key", "agent"], "left")
    return merge_into(config, source, ["key", "agent"], ["value"])


def config_values(config: DataFrame, asked: DataFrame) -> DataFrame:
    """(agent, key, value, error) for each (agent, key) asked for; ``error`` says where nothing is stored."""
    found = asked.select("agent", "key").join(config.select("agent", "key", "value", F.lit(True).alias("__there")), ["agent", "key"], "left")
    missing = F.concat(F.lit("no "), F.col("key"), F.lit(" configured for "), F.col("agent"))
    return found.select("agent", "key", "value", F.when(F.col("__there").isNull(), missing).alias("error"))
