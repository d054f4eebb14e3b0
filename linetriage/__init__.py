"""Spark operators for budgeted inspection queues and their evaluation."""
