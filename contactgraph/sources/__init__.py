"""Snapshot files, and contact networks derived from business tables."""
