"""Rules that look at a document's lines one after another: plain functions, run over texts in Arrow batches."""
