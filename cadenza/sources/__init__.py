"""Reading and the catalogue views."""
