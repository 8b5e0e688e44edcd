"""Behaviour features of visitors from click-event logs, as Spark jobs."""
