"""Evidence retrieval, property-graph and training-data operators as Spark plans."""
