"""Training-data operators.  Nothing outside this folder (but corpus_pipeline) imports it."""
