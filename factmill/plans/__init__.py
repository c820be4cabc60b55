"""Queries over the facts: passes, metrics, taint, post-processing and reports."""


def load() -> None:
    """Imports the modules that register passes."""
    from . import design, detectors, guards, performance, reliability, security, style  # noqa: F401
