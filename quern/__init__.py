"""quern: document retrieval and analytics as Spark DataFrame plans."""
