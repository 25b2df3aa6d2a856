"""tessera: column statistics, derived-column graphs and automated linear
regression on Spark DataFrames.

Sub-packages:
  sources    -- table readers/writers, derived fixtures, model artifacts
  functions  -- native Column expressions (DAG ops, normal tail, transforms,
                validation predicates, hash buckets, rounding)
  operators  -- profile, Anderson-Darling, metrics, split/folds, scaling,
                interactions, Gram moments, small solvers, registry set ops
  plans      -- DAG compiler and the automated regression fit
  streaming  -- row-wise operators applied to streaming DataFrames
"""

__version__ = "0.1.0"
