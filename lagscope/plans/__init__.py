"""Composite pipelines: scenarios, jobs and the registered query catalogue."""
