"""All registered queries and their oracle SQL, by area."""

from __future__ import annotations

from winnowline.queries import assessment, decisions, evaluation, extraction, identity, keyed, matching, pages, records, scoring, statistics

AREAS = (records, assessment, pages, extraction, identity, matching, scoring, decisions, keyed, evaluation, statistics)
QUERIES = {name: query for area in AREAS for name, query in area.QUERIES.items()}
ORACLE = {name: sql for area in AREAS for name, sql in area.ORACLE.items()}
