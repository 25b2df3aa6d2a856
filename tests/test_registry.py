import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import registry as R
from tessera.operators.frames import missing_inputs, parse_attribute_text, training_frame


@pytest.fixture(scope="module")
def reg(spark):
    owners = spark.createDataFrame([(1, "ann"), (2, "bob")], "owner_id long, name string")
    locs = spark.createDataFrame([(10, 1, "L10"), (11, 1, "L11"), (12, 2, "L12")],
                                 "location_id long, owner_id long, name string")
    wfs = spark.createDataFrame([(100, 10), (101, 11), (102, 12)], "workflow_id long, location_id long")
    models = spark.createDataFrame([(1000, 100, True), (1001, 101, False), (1002, 102, False)],
                                   "model_id long, workflow_id long, fitted boolean")
    return owners, locs, wfs, models


def test_owner_chain(reg):
    owners, locs, wfs, models = reg
    got = {r["model_id"]: r["owner_id"] for r in R.owner_chain(models, wfs, locs, owners).collect()}
    assert got == {1000: 1, 1001: 1, 1002: 2}


def test_has_fitted_and_versioned_update(reg):
    owners, locs, wfs, models = reg
    hf = {r["location_id"]: r["has_fitted_model"] for r in R.has_fitted_model(locs, wfs, models).collect()}
    assert hf == {10: True, 11: False, 12: False}
    upd = locs.withColumn("name", F.lower("name"))
    out = R.versioned_update(locs, upd, R.has_fitted_model(locs, wfs, models), "location_id",
                             rows_per_bucket=1).orderBy("location_id").collect()
    assert [(r["location_id"], r["name"], r["replaces"]) for r in out] == [
        (10, "L10", None), (11, "l11", None), (12, "l12", None), (13, "l10", 10)]


def test_cascade_delete(reg):
    owners, locs, wfs, models = reg
    wf, md = R.cascade_delete(locs.where("location_id = 10"), wfs, models)
    assert sorted(r["workflow_id"] for r in wf.collect()) == [101, 102]
    assert sorted(r["model_id"] for r in md.collect()) == [1001, 1002]


def test_metadata_upsert_delete_get(spark):
    cur = spark.createDataFrame([(1, "a", 1.0, 1), (1, "b", 2.0, 2), (2, "a", 3.0, 3)],
                                "base_id long, name string, value double, seq long")
    upd = spark.createDataFrame([(1, "a", 9.0, 10), (1, "a", 8.0, 11), (3, "c", 7.0, 12)],
                                "base_id long, name string, value double, seq long")
    up = {(r["base_id"], r["name"]): r["value"] for r in R.metadata_upsert(cur, upd).collect()}
    assert up == {(1, "a"): 8.0, (1, "b"): 2.0, (2, "a"): 3.0, (3, "c"): 7.0}
    req = spark.createDataFrame([(1, "a"), (2, None)], "base_id long, name string")
    left = {(r["base_id"], r["name"]) for r in R.metadata_delete(cur, req).collect()}
    assert left == {(1, "b")}
    wide = R.metadata_get(cur, names=["a", "b"]).orderBy("base_id").collect()
    assert wide[0]["a"] == 1.0 and wide[1]["b"] is None


def test_acl_grant_and_access(spark, reg):
    owners, locs, wfs, models = reg
    own = R.location_owners(locs)
    t = dt.datetime(2024, 1, 1)
    reqs = spark.createDataFrame([
        (1, 1, 50, "Location", 10, t + dt.timedelta(days=5), "READ", t),
        (2, 2, 50, "Location", 10, t + dt.timedelta(days=5), "READ", t),       # not the owner
        (3, 1, 50, "Location", 10, t + dt.timedelta(days=9), "WRITE", t + dt.timedelta(hours=1)),
    ], "request_id long, grantor_id long, target_user_id long, object_type string, object_id long, "
       "expiration timestamp_ntz, access_type string, ts timestamp_ntz")
    empty = spark.createDataFrame([], "owner_id long, target_user_id long, object_type string, object_id long, "
                                      "expiration timestamp_ntz, access_type string")
    acl = R.acl_grant(empty, reqs, own).collect()
    assert len(acl) == 1 and acl[0]["access_type"] == "WRITE" and acl[0]["owner_id"] == 1
    acl_df = R.acl_grant(empty, reqs, own)
    q = spark.createDataFrame([
        (1, 50, "Location", 10, t + dt.timedelta(days=1)),
        (2, 50, "Location", 10, t + dt.timedelta(days=20)),
        (3, 1, "Location", 11, t),
        (4, 2, "Location", 11, t),
    ], "request_id long, user_id long, object_type string, object_id long, as_of timestamp_ntz")
    got = {r["request_id"]: r["allowed"] for r in R.acl_access(q, own, acl_df).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}


def test_run_status(spark):
    t = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([
        (7, t, "Loading", "1/6", None, 1), (7, t + dt.timedelta(1), "Complete", "6/6", None, 2),
        (8, t, "Failed to complete", "-1/6", "Error setting data.", 3)],
        "model_id long, ts timestamp_ntz, status string, stage string, message string, event_id long")
    got = {r["model_id"]: (r["stage"], r["completed"]) for r in R.run_status(log).collect()}
    assert got == {7: ("6/6", True), 8: ("-1/6", False)}


def test_missing_ids_and_inputs(spark):
    req = spark.createDataFrame([(1, 100, 5, 9), (2, 999, 5, 8)],
                                "request_id long, workflow_id long, dataset_id long, model_id long")
    wf = spark.createDataFrame([(100,)], "id long")
    ds = spark.createDataFrame([(5,)], "id long")
    md = spark.createDataFrame([(9,)], "id long")
    out = R.missing_ids(req, {"workflow_id": wf, "dataset_id": ds, "model_id": md}).collect()
    assert len(out) == 1 and out[0]["message"] == (
        "No workflow found for id: 999, No analytical model found for id: 8")
    assert missing_inputs(["a", "b"], ["a"]) == "The following required parameters were not found: b"
    assert missing_inputs(["a"], ["a"]) == ""


def test_attributes_and_training_frame(spark):
    assert parse_attribute_text("['x1', 'x3']") == ["x1", "x3"]
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "ID long, Response double, x1 double, x2 double")
    tf = training_frame(df, attributes="['x2']")
    assert tf.columns == ["label", "x2"]
    assert training_frame(df).columns == ["label", "x1", "x2"]
    with pytest.raises(KeyError):
        training_frame(df, response="nope")
