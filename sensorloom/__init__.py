"""Machine-sensor analytics as PySpark DataFrame plans."""
