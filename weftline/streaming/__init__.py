"""The crawl's log as a stream. An extension: batch queries give the same tables."""
