"""Plan-level building blocks shared by the operators: size-checked
broadcast, skew-safe first/last/top-n per key, segmented ordered scans, and
plan assertions used by the tests."""
