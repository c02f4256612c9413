"""Reading, conforming and writing the declared tables, and rows out of landed pages and payloads."""
