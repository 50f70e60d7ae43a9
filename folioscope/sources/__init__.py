"""Readers of books, archives, catalogues and stores."""
