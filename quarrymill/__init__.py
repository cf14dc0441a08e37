"""Analytics over large document collections, written as Spark plans."""
