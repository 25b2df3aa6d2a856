"""Distributed operators: histogram ranks, profile, metrics, folds, features, Gram moments, solvers, registry."""
