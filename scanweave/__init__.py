"""A PySpark engine for sequences of range-sensor sweeps."""
