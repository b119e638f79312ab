"""Training-data operators over documents, pages and labels; nothing else in the library imports them."""
