"""Registered queries and their SQL, by name."""

from __future__ import annotations

from rillflow.plans import packetplans, scoringplans, streamplans

QUERIES = {**packetplans.QUERIES, **scoringplans.QUERIES, **streamplans.QUERIES}
SQL: dict[str, str] = {**packetplans.SQL, **scoringplans.SQL, **streamplans.SQL}
