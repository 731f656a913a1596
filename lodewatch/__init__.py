"""Lodewatch: a PySpark-native engine for host-security telemetry."""
