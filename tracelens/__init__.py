"""Tracelens: a PySpark-native analytics engine for operational telemetry."""
