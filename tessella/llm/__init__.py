"""Training-data pipeline operators.

Nothing outside this package imports it.  Every operator reads and returns
DataFrames; the thin query wrappers that the driver calls are in ``queries``.
"""
