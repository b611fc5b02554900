"""DataFrame -> DataFrame operators (relational work runs on Spark)."""
