"""operators of the document engine."""
