"""Part of tessera, a PySpark-native governance and analytics engine."""
