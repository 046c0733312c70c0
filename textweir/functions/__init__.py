"""Scalar rules as Column -> Column functions; all stay in the JVM."""
