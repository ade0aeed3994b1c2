"""Training-data operators over documents and web pages. Nothing else in the library imports this package."""
