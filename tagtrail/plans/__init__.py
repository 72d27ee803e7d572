"""The registered queries: operators bound to the shared Parquet tables, with their oracle SQL."""
