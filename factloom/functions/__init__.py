"""Scalar functions on columns, all JVM-side, and helpers that build patterns on the driver."""
