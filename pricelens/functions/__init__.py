"""Column functions: everything here is a Catalyst expression over arrays or scalars."""
