"""Analytics over advertising signals in streaming video, as Spark jobs."""
