"""Files that land over time."""
