"""Scalar column builders: every function takes and returns a Column and stays inside the JVM unless it says otherwise."""
