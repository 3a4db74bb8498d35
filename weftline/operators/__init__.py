"""Operators over tables of pages, links, assets and crawl state."""
