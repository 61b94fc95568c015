"""velotide: trip-demand analytics as Spark DataFrame functions."""
