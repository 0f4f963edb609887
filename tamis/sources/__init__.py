"""Reading tables without loss, writing results, and the registry of datasets."""
