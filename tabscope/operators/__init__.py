"""DataFrame-in, DataFrame-out profiling and catalog operators."""
