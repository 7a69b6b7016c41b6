"""millrace: a PySpark-native SQL analytics engine (DataFrame, SQL and Catalyst first)."""
