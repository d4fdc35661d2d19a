"""Evidence held in documents: validity, retrieval, text, evaluation and ingestion as DataFrame operators."""
