"""Claims over a corpus: documentation, source trees and their history as tables, checked by Spark plans."""
