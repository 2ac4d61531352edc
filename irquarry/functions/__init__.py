"""Column expressions.  All of them run inside the JVM; none is a Python UDF."""
