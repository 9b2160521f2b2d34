from evigraph.sources.tables import hash_sample, latest_rows, read_table

__all__ = ["hash_sample", "latest_rows", "read_table"]
