"""Production-cycle and cohort analytics as plain PySpark DataFrame operators."""
