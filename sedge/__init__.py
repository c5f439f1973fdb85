"""sedge: document retrieval and knowledge-graph analytics as composable Spark DataFrame plans."""
