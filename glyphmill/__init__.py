"""glyphmill: corpus retrieval, sequence labelling and text-data operators on PySpark."""
