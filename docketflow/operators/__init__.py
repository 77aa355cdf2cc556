"""Relational operators over docket tables."""
