"""Asset-catalog analytics on Spark: predicate search, hierarchies, DML as DataFrames, change feeds."""

__version__ = "0.1.0"
