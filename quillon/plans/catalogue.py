"""Modules of named queries outside the optional subpackage."""

from __future__ import annotations

from quillon.plans import data_problems, details, feeding, forecast, indicators, joining, records, scoring, studying

FLAGSHIP = "p1_found"


def modules() -> list:
    return [data_problems, indicators, joining, scoring, records, studying, feeding, forecast, details]
