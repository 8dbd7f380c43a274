"""tickforge: a PySpark-native engine for market-data tapes."""
