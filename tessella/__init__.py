"""A PySpark-native engine for time-series similarity analytics.

The array calls of ``tessella.api`` are also attributes of the package; they
load on first use, so that Spark's Python workers need not import them.
"""

__version__ = "0.1.0"

_CALLS = frozenset({
    "aamp", "aamp_match", "estimated_peak_bytes", "gpu_aamp", "gpu_stimp", "gpu_stump", "mass", "mass_absolute",
    "match", "mparray", "prepare_target", "PreparedTarget", "stimp", "stump",
})


def __getattr__(name: str):
    if name in _CALLS:
        from importlib import import_module

        return getattr(import_module("tessella.api"), name)
    raise AttributeError(f"module 'tessella' has no attribute {name!r}")
