"""DataFrame operators: joins, metrics, thresholds, policies, resampling, features."""
