"""Analytics over corpora of source and text, written for Spark."""
