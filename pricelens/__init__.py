"""PySpark operators for measuring probabilistic forecasts against market prices."""
