"""Writers and the row shapes they write."""
