"""Sleep-signal quality, labels, releases and window reads as Spark DataFrame operators."""
