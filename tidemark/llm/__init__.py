"""Training-data operators on document and page tables; nothing else in the package imports them."""
