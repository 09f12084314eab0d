"""Errors raised while a plan is built; rows never raise."""

from __future__ import annotations


class ScreeningError(Exception):
    """The base of all errors of this package."""


class DetectionError(ScreeningError):
    """A detector can't be built."""

    def __init__(self, message: str, detector: str, original: Exception | None = None) -> None:
        super().__init__(message)
        self.detector, self.original = detector, original


class PipelineError(ScreeningError):
    """A screening can't be assembled."""

    def __init__(self, message: str, results: list | None = None) -> None:
        super().__init__(message)
        self.results = results or []


class ConfigurationError(ScreeningError):
    """A rule or a setting is invalid."""
