"""Event analytics for satellite thermal anomalies, as PySpark DataFrame operators."""
