"""Audit of source trees as Spark jobs, and operations of a training-data pipeline."""
