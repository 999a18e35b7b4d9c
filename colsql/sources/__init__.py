"""Versioned tables and intermediate files."""
