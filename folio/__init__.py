"""Page-level document interpretations to validated, publishable documents, on Spark."""
