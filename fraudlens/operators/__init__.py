"""Operators: each is a function DataFrame(s) -> DataFrame built from
Spark SQL / DataFrame primitives (or a Spark ML stage)."""
