"""Sources: cell files, tables of results, sidecar and configuration files."""
