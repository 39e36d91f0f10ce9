"""Pennybrook: a Spark-native statement-ledger engine."""
