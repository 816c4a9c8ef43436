"""Storage-deduplication analytics on PySpark."""

from importlib import import_module

_API = {
    "chunks": "plans.experiment", "compare_formats": "plans.experiment", "compare_formats_tables": "plans.experiment", "estimate": "plans.experiment",
    "strips_html": "plans.report", "visualize": "plans.visualize",
}

__all__ = list(_API)


def __getattr__(name: str):
    """The public functions, loaded when first used, so that Python workers import only what they run."""
    if name in _API:
        return getattr(import_module(f".{_API[name]}", __name__), name)
    raise AttributeError(name)
