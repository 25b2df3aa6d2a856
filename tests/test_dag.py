import math

import pytest
from pyspark.sql import functions as F

from tessera.plans.dag import DagError, apply_dag, apply_node, parse_spec, topological_order

EXAMPLE = {
    "nodes": {
        1: {"function": "add", "args": {"c1": "x1", "c2": "x3"}},
        2: {"function": "square", "args": {"c": "x3"}},
        3: {"function": "square", "args": {"c": "x1+x3"}},
        4: {"function": "normalize", "args": {"c": "x5"}},
    },
    "edges": [[1, 3]],
}


@pytest.fixture
def frame(spark):
    rows = [(1, 1.0, 2.0, 3.0, 0.0, 3.0), (2, 2.0, 0.5, -1.0, 1.0, 4.0), (3, 0.0, 1.0, 2.0, 5.0, 0.0)]
    return spark.createDataFrame(rows, "id long, x1 double, x2 double, x3 double, x4 double, x5 double")


def test_order_is_lifo_like_the_reference(frame):
    out = apply_dag(frame, EXAMPLE)
    assert out.columns[6:] == ["x5n", "(x3)^2", "x1+x3", "(x1+x3)^2"]


def test_values_match_numpy(frame):
    import numpy as np
    out = apply_dag(frame, EXAMPLE).orderBy("id").toPandas()
    x1, x3, x5 = out["x1"].to_numpy(), out["x3"].to_numpy(), out["x5"].to_numpy()
    assert np.allclose(out["x1+x3"], x1 + x3)
    assert np.allclose(out["(x1+x3)^2"], (x1 + x3) ** 2)
    assert np.allclose(out["x5n"], x5 / np.linalg.norm(x5))


def test_mixed_id_types_and_string_json(frame):
    import json
    spec = parse_spec(json.dumps({"nodes": {"1": EXAMPLE["nodes"][1], "3": EXAMPLE["nodes"][3]},
                                  "edges": [[1, "3"]]}))
    assert spec.order() == ["1", "3"]


@pytest.mark.parametrize("bad,msg", [
    ({"nodes": {"1": {"function": "exp", "args": {"c": "x1"}}}, "edges": []}, "unknown function"),
    ({"nodes": {"1": {"function": "add", "args": {"c1": "x1"}}}, "edges": []}, "takes arguments"),
    ({"nodes": {"1": {"function": "log", "args": {"c": "x1"}}}, "edges": [[1, 2]]}, "unknown node"),
    ({"nodes": {"1": {"function": "log", "args": {"c": "nope"}}}, "edges": []}, "does not exist"),
])
def test_rejects_bad_specs(frame, bad, msg):
    with pytest.raises(DagError, match=msg):
        apply_dag(frame, bad)


def test_cycle_rejected():
    with pytest.raises(DagError, match="cycle"):
        topological_order(["a", "b"], [("a", "b"), ("b", "a")])


def test_duplicate_output_same_definition_once(frame):
    spec = {"nodes": {"1": {"function": "square", "args": {"c": "x1"}},
                      "2": {"function": "square", "args": {"c": "x1"}}}, "edges": []}
    assert apply_dag(frame, spec).columns.count("(x1)^2") == 1


def test_duplicate_output_different_definition_rejected(frame):
    spec = {"nodes": {"1": {"function": "add", "args": {"c1": "x3", "c2": "x2"}},
                      "2": {"function": "add", "args": {"c1": "x1", "c2": "x3"}},
                      "3": {"function": "add", "args": {"c1": "x1", "c2": "x3+x2"}},
                      "4": {"function": "add", "args": {"c1": "x1+x3", "c2": "x2"}}},
            "edges": [[1, 3], [2, 4]]}
    with pytest.raises(DagError, match="different node"):
        apply_dag(frame, spec)


def test_logs_follow_numpy_for_zero_and_negative(frame):
    out = apply_node(frame, "log", c="x3").orderBy("id").select("ln(x3)").collect()
    vals = [r[0] for r in out]
    assert vals[0] == pytest.approx(math.log(3.0))
    assert math.isnan(vals[1])
    out10 = apply_node(frame, "log10", c="x1").orderBy("id").select("log10(x1)").collect()
    assert out10[2][0] == float("-inf")


def test_zero_norm_gives_nan(spark):
    df = spark.createDataFrame([(0.0,), (0.0,)], "z double")
    vals = [r[0] for r in apply_node(df, "normalize", c="z").select("zn").collect()]
    assert all(math.isnan(v) for v in vals)


def test_integer_square_does_not_overflow(spark):
    df = spark.createDataFrame([(3_000_000_000,)], "big long")
    v = apply_node(df, "square", c="big").select("(big)^2").first()[0]
    assert v == pytest.approx(9e18)


def test_plan_is_native(frame):
    plan = apply_dag(frame, EXAMPLE)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan


def test_new_only(frame):
    out = apply_dag(frame, EXAMPLE, new_only=True)
    assert out.columns == ["x5n", "(x3)^2", "x1+x3", "(x1+x3)^2"]


def test_registered_operation_joins_the_graph(spark):
    from pyspark.sql import functions as F
    from tessera.functions import columns as C
    from tessera.plans.dag import apply_dag
    C.register_operation(C.Operation("halve", ("c",), lambda c: f"half {c}", lambda c: F.col(c) / 2))
    try:
        out = apply_dag(spark.createDataFrame([(4.0,)], "x double"), {"nodes": {"1": {"function": "halve", "args": {"c": "x"}}}, "edges": []})
        assert out.first()["half x"] == 2.0
        with pytest.raises(ValueError):
            C.register_operation(C.OPERATIONS["halve"])
    finally:
        del C.OPERATIONS["halve"]
