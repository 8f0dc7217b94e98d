"""docquery: document retrieval, its preparation and its evaluation as Spark DataFrame operators."""
