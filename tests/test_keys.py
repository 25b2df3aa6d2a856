"""The registry's key graph on hand-made tables."""
import pytest
from pyspark.sql import functions as F

from tessera.operators import keys as K


@pytest.fixture(scope="module")
def reg(spark):
    def df(rows, schema):
        return spark.createDataFrame(rows, schema)
    return {
        "user": df([(1,), (2,), (3,)], "user_id long"),
        "location": df([(10, 1), (11, 2), (12, None), (13, 9)], "location_id long, owner_id long"),
        "workflow": df([(20, 10), (21, 11), (22, 12), (23, None)], "workflow_id long, location_id long"),
        "analytical_model": df([(30, 20, True, "x"), (31, 20, False, "x"), (32, 21, False, "x"), (33, None, True, "x")],
                               "model_id long, workflow_id long, fitted boolean, model string"),
        "dataset": df([(40, 20, "x"), (41, 21, "x"), (42, None, "x")], "dataset_id long, workflow_id long, data string"),
        "dataset_metadata": df([(40, "a"), (40, "b"), (41, "a"), (99, "z")], "base_id long, name string"),
        "model_results": df([(30, 0.5), (32, 0.6)], "model_id long, result double"),
        "access_control_list": df([(1, 2, 10), (2, 1, 11), (2, 3, 11), (3, 3, 5)], "owner_id long, target_user_id long, object_id long"),
    }


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_owners_of_every_type(reg):
    assert rows(K.object_owners(reg), "object_type", "object_id", "owner_id") == [
        ("AnalyticalModel", 30, 1), ("AnalyticalModel", 31, 1), ("AnalyticalModel", 32, 2), ("Dataset", 40, 1), ("Dataset", 41, 2),
        ("Location", 10, 1), ("Location", 11, 2), ("Workflow", 20, 1), ("Workflow", 21, 2)]


def test_integrity(reg):
    got = {(r.object_type, r.object_id) for r in K.integrity(reg, F.col("fitted")).collect() if r.has_fitted_model}
    assert got == {("Location", 10), ("Workflow", 20), ("Dataset", 40)}
    assert K.integrity(reg, F.col("fitted")).count() == 4 + 4 + 3


def test_cascade_follows_every_key(reg):
    left = K.REGISTRY.cascade(reg, "user", reg["user"].where("user_id = 1"))
    assert rows(left["user"], "user_id") == [(2,), (3,)]
    assert sorted(r.location_id for r in left["location"].collect()) == [11, 12, 13]
    assert sorted(r.workflow_id for r in left["workflow"].collect()) == [21, 22, 23]
    assert sorted(r.model_id for r in left["analytical_model"].collect()) == [32, 33]
    assert sorted(r.dataset_id for r in left["dataset"].collect()) == [41, 42]
    assert rows(left["dataset_metadata"], "base_id", "name") == [(41, "a"), (99, "z")]
    assert rows(left["model_results"], "model_id") == [(32,)]
    # grants from and to the user
    assert rows(left["access_control_list"], "owner_id", "target_user_id") == [(2, 3), (3, 3)]
    assert left["location"].columns == reg["location"].columns or set(left["location"].columns) == set(reg["location"].columns)
    nothing = K.REGISTRY.cascade(reg, "workflow", reg["workflow"].where("false"))
    assert all(nothing[t].count() == reg[t].count() for t in reg)


def test_listing_by_parent_prunes_the_payload(reg):
    kids = K.REGISTRY.children(reg, "workflow", "dataset", F.col("location_id") == 10)
    assert set(kids.columns) == {"dataset_id", "workflow_id"} and [r.dataset_id for r in kids.collect()] == [40]
    with pytest.raises(K.RegistryError):
        K.REGISTRY.children(reg, "location", "dataset")


def test_graph_is_checked():
    with pytest.raises(K.RegistryError, match="no primary key"):
        K.KeyGraph({"a": "id"}, (K.ForeignKey("a", "b_id", "b"),))
    with pytest.raises(K.RegistryError, match="cycle"):
        K.KeyGraph({"a": "id", "b": "id"}, (K.ForeignKey("a", "b_id", "b"), K.ForeignKey("b", "a_id", "a")))
    with pytest.raises(K.RegistryError, match="no key leads"):
        K.REGISTRY.path("location", "dataset")
    order = K.REGISTRY.order()
    assert all(order.index(k.parent) < order.index(k.child) for k in K.REGISTRY.keys)
