"""A reader of page-description files: bytes to pages, characters and shapes."""
