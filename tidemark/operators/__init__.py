"""The engine's operators: folds, learners, covariates, targeting, effects, inference and diagnostics."""
