"""Camera-stream and media-timeline analytics as Spark DataFrame operators."""
