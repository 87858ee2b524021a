"""Veridex: a PySpark-native engine for evidence auditing and ledger reconciliation."""
