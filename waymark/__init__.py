"""Spark-first analytics over activity traces and the relational data around them."""
