"""Scalar functions as Column expressions; everything stays in the JVM but where noted."""
