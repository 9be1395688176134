"""Event, content and provenance analytics as Spark DataFrame operators."""
