"""Scans of files that measurement tools leave: run logs, profiles, CSV tables, table lines, reports, whole files."""
