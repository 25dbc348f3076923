"""Spark-first spatial recall: hex cells, slot sketches, bounded samples, similarity recall and their evaluation."""
