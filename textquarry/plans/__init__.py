"""The registered queries, by phase: name -> (function of a session and a folder, SQL for DuckDB or None)."""
