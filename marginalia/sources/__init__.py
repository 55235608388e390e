"""Sources: vault folders and the registry."""
