"""folio: reference-library analytics and text processing as Spark DataFrame operations."""
