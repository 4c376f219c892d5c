"""Checks, verdicts, the runners that sequence them, and the query catalogue."""
