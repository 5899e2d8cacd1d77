"""Natural-language analytics and data processing on Spark."""
