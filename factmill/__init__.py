"""factmill: code-fact analytics as Spark DataFrame queries."""
