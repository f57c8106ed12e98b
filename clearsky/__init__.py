"""clearsky: satellite-navigation signal quality analytics as Spark jobs."""
