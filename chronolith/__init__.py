"""Analytics over dated text corpora, written as Spark DataFrame plans."""

__version__ = "0.1.0"
