"""Tideguard: Spark DataFrame operators that find denial-of-service attacks and other traffic anomalies."""
