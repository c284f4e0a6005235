"""granary: retail demand and customer analytics as Spark DataFrame pipelines."""
