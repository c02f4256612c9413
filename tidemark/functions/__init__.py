"""Column builders: no Python UDF, only expressions that stay in the JVM."""
