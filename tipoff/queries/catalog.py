"""Imports every query module so that the registry is complete."""

from __future__ import annotations

from tipoff.queries import aggregates, features, models, payloads, scans, windows  # noqa: F401
from tipoff.queries.registry import callables, oracles  # noqa: F401
