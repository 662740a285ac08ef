"""seekstone: a PySpark-native engine for searching and ranking catalogs of named things."""
