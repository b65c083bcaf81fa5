from tabsmith.sources.io import preview, read_csv, read_table, write_version  # noqa: F401
