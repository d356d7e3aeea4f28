"""Column -> Column functions, all compositions of Spark built-ins."""
