"""millrace: exactly-once table-to-table streaming on Spark, and operators for it."""
