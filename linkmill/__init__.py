"""linkmill: entity resolution and research-impact analytics as Spark DataFrame operators."""
