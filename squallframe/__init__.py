"""squallframe: severe-wind and thunderstorm climate analytics as Spark DataFrame operators."""
