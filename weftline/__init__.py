"""Weftline: analytics over web corpora held as tables, and the steps of a training-data pipeline, on PySpark."""
