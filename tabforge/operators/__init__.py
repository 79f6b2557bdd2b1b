"""DataFrame-to-DataFrame operators: profiling, roles, metrics, run analysis."""
