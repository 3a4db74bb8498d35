"""Column functions: URLs, local paths, text and encodings, and the policies over them."""
