from notemesh.sources.tables import hashed_sample, once, read_table, table_path  # noqa: F401
