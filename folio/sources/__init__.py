"""Sources: wire JSON, carriers over the driver's tables, page sources, committed files."""
