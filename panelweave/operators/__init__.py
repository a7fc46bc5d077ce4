"""DataFrame operators: joins, reshapes, windows, statistics, splits, models."""
