"""Reading and writing manifests, race files and the results warehouse."""
