"""Analytics over source trees and document corpora on Spark."""

__version__ = "0.1.0"
