"""siltstone: versioned key/value data as Spark DataFrames.

One fixed changelog relation ``(key, seq, op, value)`` carries every feature;
operators are functions from DataFrame to DataFrame, and a store directory is
sorted Parquet runs plus a replayable manifest.
"""

from siltstone.model import DELETE, PUT, Options

__all__ = ["DELETE", "PUT", "Options"]
