"""DuckDB SQL by the name of the query that it must equal."""

from __future__ import annotations

from colloquy.plans import base_oracles, files_oracles, landed_oracles, notes_oracles, streams_oracles

SQL: dict[str, str] = base_oracles.SQL | landed_oracles.SQL | notes_oracles.SQL | files_oracles.SQL | streams_oracles.SQL
