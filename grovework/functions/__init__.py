"""Column functions: no UDFs, so they stay inside generated code where Spark can."""
