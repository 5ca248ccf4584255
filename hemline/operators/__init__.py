"""DataFrame operators: each takes and returns lazy DataFrames unless it says otherwise."""
