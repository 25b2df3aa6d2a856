"""Registry operators (R1-R13): the model/dataset bookkeeping expressed as
set-based DataFrame operations that answer for every id at once.

Tables (plain DataFrames; keys: ``keys.REGISTRY``):
  owners(owner_id) <- locations(location_id, owner_id, name)
  <- workflows(workflow_id, location_id) <- models(model_id, workflow_id, fitted)
  metadata(base_id, name, value, seq); acl(owner_id, target_user_id,
  object_type, object_id, expiration, access_type); run_log(model_id, ts,
  status, stage, message, event_id).

Joins are left to Catalyst/AQE: dimension-sized sides are broadcast by the
planner's size statistics, large ones shuffle on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .histogram import global_rank
from .keys import REGISTRY

# -------------------------------------------------------------- listings

def list_children(children: DataFrame, parents: DataFrame | None = None, fk: str | None = None,
                  pk: str | None = None, payload: tuple[str, ...] = ("data",)) -> DataFrame:
    """Children of existing parents, payload columns pruned (never read)."""
    out = children.drop(*[p for p in payload if p in children.columns])
    if parents is not None:
        out = out.join(parents.select(F.col(pk).alias(fk)), fk, "left_semi")
    return out


# -------------------------------------------------------------- metadata

def metadata_latest(log: DataFrame) -> DataFrame:
    """Unique (base_id, name): the last write (highest seq) wins."""
    return (log.groupBy("base_id", "name")
            .agg(F.max_by(F.struct("value", "seq"), "seq").alias("last"))
            .select("base_id", "name", "last.value", "last.seq"))


def metadata_get(meta: DataFrame, names: list[str] | None = None, wide: bool = True) -> DataFrame:
    """R2: name -> value per base.  With ``names``: only those names, first
    write per name (lowest seq), one column per name; without: every name,
    last write wins, long form."""
    if names:
        sub = meta.where(F.col("name").isin(names))
        if not wide:
            return sub.groupBy("base_id", "name").agg(F.min_by("value", "seq").alias("value"))
        return sub.groupBy("base_id").pivot("name", names).agg(F.min_by("value", "seq"))
    return metadata_latest(meta).select("base_id", "name", "value")


def metadata_upsert(current: DataFrame, updates: DataFrame) -> DataFrame:
    """Upsert by (base_id, name); within the batch the last write wins, and
    a write of null overwrites too."""
    batch = metadata_latest(updates).select("base_id", "name", F.struct("value", "seq").alias("new"))
    cur = current.select("base_id", "name", "value", "seq")
    j = cur.join(batch, ["base_id", "name"], "full_outer")
    written = F.col("new").isNotNull()
    return j.select("base_id", "name", *[F.when(written, F.col("new")[c]).otherwise(F.col(c)).alias(c) for c in ("value", "seq")])


def metadata_delete(meta: DataFrame, requests: DataFrame) -> DataFrame:
    """Delete by (base_id, name); a request with a null name deletes all
    of the base's metadata."""
    r = requests.select(F.col("base_id").alias("r_base"), F.col("name").alias("r_name"))
    cond = (meta.base_id == r.r_base) & (r.r_name.isNull() | (meta.name == r.r_name))
    return meta.join(r, cond, "left_anti")


# -------------------------------------------------------------- ownership

def owner_chain(models: DataFrame, workflows: DataFrame, locations: DataFrame,
                owners: DataFrame) -> DataFrame:
    """Model -> workflow -> location -> owner for every model."""
    return (models.select("model_id", "workflow_id")
            .join(workflows.select("workflow_id", "location_id"), "workflow_id")
            .join(locations.select("location_id", "owner_id"), "location_id")
            .join(owners.select("owner_id"), "owner_id")
            .select("model_id", "workflow_id", "location_id", "owner_id"))


def location_owners(locations: DataFrame) -> DataFrame:
    return locations.select(F.lit("Location").alias("object_type"),
                            F.col("location_id").alias("object_id"), "owner_id")


ACL_KEY = ["owner_id", "target_user_id", "object_type", "object_id"]


def acl_grant(acl: DataFrame, requests: DataFrame, object_owners: DataFrame) -> DataFrame:
    """Only the object's owner may grant; insert or update expiration and
    access type per (owner, target, object); the latest request wins."""
    valid = requests.join(
        object_owners.select("object_type", "object_id", F.col("owner_id").alias("grantor_id")),
        ["object_type", "object_id", "grantor_id"], "left_semi")
    latest = (valid.groupBy(F.col("grantor_id").alias("owner_id"), "target_user_id", "object_type", "object_id")
              .agg(F.max_by(F.struct("expiration", "access_type"), F.struct("ts", "request_id")).alias("g")))
    j = acl.select(*ACL_KEY, "expiration", "access_type").join(latest, ACL_KEY, "full_outer")
    given = F.col("g").isNotNull()
    return j.select(*ACL_KEY, *[F.when(given, F.col("g")[c]).otherwise(F.col(c)).alias(c) for c in ("expiration", "access_type")])


def acl_access(requests: DataFrame, object_owners: DataFrame, acl: DataFrame) -> DataFrame:
    """A request (request_id, user_id, object_type, object_id, as_of) is
    allowed when the user owns the object or holds a grant unexpired at
    ``as_of``.  A grant is unexpired iff the latest expiry for (user, object)
    is later than ``as_of``, so the ACL is first reduced to one row per key
    (small, map-side combined) and joined once -- no row duplication."""
    who = ["user_id", "object_type", "object_id"]
    owns = object_owners.select(F.col("owner_id").alias("user_id"), "object_type", "object_id", F.lit(True).alias("owns"))
    latest = (acl.groupBy(F.col("target_user_id").alias("user_id"), "object_type", "object_id")
              .agg(F.max("expiration").alias("latest_expiry")))
    # both joins are on the user as well, so a hot object is dealt by its users
    j = requests.join(owns, who, "left").join(latest, who, "left")
    is_owner = F.coalesce("owns", F.lit(False))
    granted = F.coalesce(F.col("latest_expiry") > F.col("as_of"), F.lit(False))
    return j.select("request_id", *who, is_owner.alias("is_owner"), (is_owner | granted).alias("allowed"))


# -------------------------------------------------------------- integrity

def has_fitted_model(locations: DataFrame, workflows: DataFrame, models: DataFrame) -> DataFrame:
    """Per location, does any model with a fitted artifact sit below it?"""
    # pre-aggregated: a workflow with a third of all models collapses map-side
    fitted = models.where(F.col("fitted")).select("workflow_id").distinct()
    locs = (workflows.join(fitted, "workflow_id", "left_semi")
            .select("location_id").distinct().withColumn("has_fitted_model", F.lit(True)))
    return (locations.select("location_id").join(locs, "location_id", "left")
            .select("location_id", F.coalesce("has_fitted_model", F.lit(False)).alias("has_fitted_model")))


def versioned_update(table: DataFrame, updates: DataFrame, protected: DataFrame, key: str,
                     order: str | None = None, rows_per_bucket: int | None = None) -> DataFrame:
    """Apply updates (same columns as ``table``, and ``order`` if given);
    rows with a fitted model below them (``protected``: key, has_fitted_model)
    keep their old version and the update is inserted with a new id = max(id) +
    rank among the new rows; others are overwritten in place.  Of several
    updates of one key the last by ``order`` counts (without it the greatest
    row).  Ranks are taken on the keys in their own type.  Output adds
    ``replaces``."""
    fields = F.struct(*[c for c in table.columns if c != key])
    last = (F.max_by(fields, order) if order else F.max(fields)).alias("new")
    upd = updates.groupBy(key).agg(last).select(*[F.col(key) if c == key else F.col("new")[c].alias(c) for c in table.columns])
    upd = upd.join(protected, key, "left")
    keep_old = F.coalesce(F.col("has_fitted_model"), F.lit(False))
    in_place = upd.where(~keep_old).drop("has_fitted_model")
    versioned = upd.where(keep_old).drop("has_fitted_model")
    kind = table.schema[key].dataType
    max_id = table.select(F.max(key)).scalar()
    ranks = global_rank(versioned.select(F.col(key).alias("k")), rows_per_bucket).withColumnRenamed("k", key)
    new_rows = (versioned.join(ranks, key).withColumn("replaces", F.col(key))
                .withColumn(key, (F.coalesce(max_id, F.lit(0)) + F.col("r") + 1).cast(kind)).drop("r"))
    none = F.lit(None).cast(kind)
    untouched = table.join(in_place.select(key), key, "left_anti").withColumn("replaces", none)
    overwritten = in_place.withColumn("replaces", none)
    cols = table.columns + ["replaces"]
    return untouched.select(cols).unionByName(overwritten.select(cols)).unionByName(new_rows.select(cols))


def cascade_delete(deleted_locations: DataFrame, workflows: DataFrame, models: DataFrame
                   ) -> tuple[DataFrame, DataFrame]:
    """Removing locations removes their workflows and those models (all
    tables: ``keys.REGISTRY.cascade``)."""
    out = REGISTRY.cascade({"workflow": workflows, "analytical_model": models}, "location", deleted_locations)
    return out["workflow"], out["analytical_model"]


# -------------------------------------------------------------- run status

#: Columns of the run log.
RUN_LOG = "model_id long, ts timestamp, event_id long, status string, stage string, message string"


def run_log_rows(spark, model_id: int, events: list[tuple]) -> DataFrame:
    """Status writes (ts, event_id, status, stage, message) of one model as
    rows of the run log; a later write replaces an earlier one, its message too."""
    return spark.createDataFrame([(model_id, *e) for e in events], RUN_LOG)


def run_status(run_log: DataFrame) -> DataFrame:
    """Latest status row per model; stage 'i/n' parsed; complete
    when i = n (failures are '-1/n')."""
    latest = (run_log.groupBy("model_id")
              .agg(F.max_by(F.struct("status", "stage", "message"), F.struct("ts", "event_id")).alias("s")))
    parts = F.split(F.col("s.stage"), "/")
    step = parts.getItem(0).cast("int")
    steps = parts.getItem(1).cast("int")
    return latest.select("model_id", F.col("s.status").alias("status"), F.col("s.stage").alias("stage"),
                         F.col("s.message").alias("message"), step.alias("step"), steps.alias("steps"),
                         (step == steps).alias("completed"))


# Messages for ids that do not exist.
MISSING_MESSAGES = {
    "workflow_id": "No workflow found for id: ",
    "dataset_id": "No dataset found for id: ",
    "model_id": "No analytical model found for id: ",
}


def missing_ids(requests: DataFrame, lookups: dict[str, DataFrame]) -> DataFrame:
    """Per request, the ', '-joined messages for ids not found.
    ``lookups`` maps a request column to a one-column table of existing ids."""
    out = requests
    msgs: list[Column] = []
    for col, ids in lookups.items():
        flag = f"_has_{col}"
        found = ids.select(F.col(ids.columns[0]).alias(col)).distinct().withColumn(flag, F.lit(True))
        out = out.join(found, col, "left")
        msgs.append(F.when(F.col(flag).isNull(),
                           F.concat(F.lit(MISSING_MESSAGES.get(col, f"No {col} found for id: ")),
                                    F.col(col).cast("string"))))
    message = F.concat_ws(", ", *msgs)
    return out.select(*requests.columns, message.alias("message")).where(F.col("message") != "")
