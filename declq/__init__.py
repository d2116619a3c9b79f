"""Declarative query derivation and pipeline analytics on PySpark."""
