"""conceptweave: concept-graph text analytics as Spark DataFrame transformations."""
