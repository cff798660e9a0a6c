"""Reading tables, shared scratch folders and versioned table directories."""
