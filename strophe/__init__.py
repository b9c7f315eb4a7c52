"""Sequence analytics on Spark: event-sequence operators, corpus tools and training-data operators."""
