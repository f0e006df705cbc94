"""Column functions: every one maps Columns to a Column and stays in the JVM."""
