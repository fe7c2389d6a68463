"""Operators of a training-data pipeline on Spark; nothing else in the package imports this folder."""
