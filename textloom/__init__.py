"""Analytics over semi-structured text, records and tables as Spark plans."""
