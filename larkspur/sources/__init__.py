"""The catalog, outside tables, pragmas and schema tables."""
