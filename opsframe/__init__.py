"""Table and stream operators for the data work around running a big-data platform."""
