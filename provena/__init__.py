"""Text-provenance analytics on Spark: where a text comes from and how faithfully it is quoted."""
