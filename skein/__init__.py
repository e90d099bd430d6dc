"""skein: a PySpark-native analytics engine for typed, evidence-backed knowledge graphs."""
