"""sources of the document engine."""
