"""DataFrame operators over cells: rows (tile, row, col) with one column per band; NULL is missing."""
