"""Document-review analytics as Spark DataFrame pipelines."""
