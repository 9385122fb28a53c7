"""Column functions: parsing and normalising text."""
