import tempfile

from pyspark.sql import functions as F

from tessera.plans.dag import apply_dag
from tessera.sources import fixtures as fx
from tessera.streaming.rowwise import derive_stream, parquet_stream, run_to_table

ROWWISE = {"nodes": {"1": {"function": "add", "args": {"c1": "x1", "c2": "x3"}},
                     "2": {"function": "log", "args": {"c": "x1+x3"}}}, "edges": [[1, 2]]}


def test_stream_matches_batch(spark, sf_tiny):
    batch = fx.dag_frame(spark, sf_tiny)
    src = tempfile.mkdtemp(prefix="tessera-src-")
    batch.repartition(3).write.mode("overwrite").parquet(src)
    stream = parquet_stream(spark, src, batch.schema, max_files_per_trigger=1)
    out = tempfile.mkdtemp(prefix="tessera-out-")
    ck = tempfile.mkdtemp(prefix="tessera-ck-")
    run_to_table(derive_stream(stream, ROWWISE), out, ck)
    got = spark.read.parquet(out)
    want = apply_dag(batch, ROWWISE)
    assert got.count() == want.count()
    assert got.select(F.sum("ln(x1+x3)")).first()[0] == want.select(F.sum("ln(x1+x3)")).first()[0] or \
        abs(got.select(F.sum("ln(x1+x3)")).first()[0] - want.select(F.sum("ln(x1+x3)")).first()[0]) < 1e-6


def test_predict_stream_matches_batch(spark, sf_tiny):
    from tessera.plans.autoreg import fit_auto_regression
    from tessera.streaming.rowwise import predict_stream
    df = fx.order_features(spark, sf_tiny)
    fit = fit_auto_regression(df, "sum_ext", ["n_lines", "sum_qty"], key="id")
    src = tempfile.mkdtemp(prefix="tessera-psrc-")
    df.repartition(2).write.mode("overwrite").parquet(src)
    out = tempfile.mkdtemp(prefix="tessera-pout-")
    ck = tempfile.mkdtemp(prefix="tessera-pck-")
    run_to_table(predict_stream(parquet_stream(spark, src, df.schema), fit.model), out, ck)
    got = {r["id"]: r["prediction"] for r in spark.read.parquet(out).select("id", "prediction").collect()}
    want = {r["id"]: r["prediction"] for r in fit.model.predict(df).select("id", "prediction").collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 1e-9 * max(1.0, abs(want[k])) for k in want)
