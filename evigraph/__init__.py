"""evigraph: evidence retrieval and citation-graph analytics on PySpark."""
