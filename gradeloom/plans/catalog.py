"""Imports every query module so that its registrations take place."""

from __future__ import annotations

import importlib

MODULES = (
    "scalars",
    "marks",
    "grading",
    "state",
    "issues",
    "changes",
    "checks",
    "identity",
    "evaluation",
    "curation",
    "geometry",
    "files",
    "streams",
)


def load() -> None:
    for module in MODULES:
        importlib.import_module(f"gradeloom.plans.q_{module}")
