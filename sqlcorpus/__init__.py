"""Text-to-SQL corpora and run analytics as Spark DataFrame jobs."""
