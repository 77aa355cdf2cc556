"""Spark-native engine for event dockets: ingest, folds, context joins, audits, feeds and scoring."""
