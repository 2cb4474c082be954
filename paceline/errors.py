"""Errors raised by the single-request entry points."""

from __future__ import annotations


class InvalidRequest(ValueError):
    """The arguments contradict each other or name something unknown."""


class NotFound(LookupError):
    """Nothing matches; `context` says what does exist."""

    def __init__(self, message: str, **context):
        super().__init__(message)
        self.context = context


class Ambiguous(LookupError):
    """More than one athlete matches where one was asked for."""

    def __init__(self, message: str, candidates=()):
        super().__init__(message)
        self.candidates = list(candidates)
