"""Column-expression builders: everything here stays inside Catalyst."""
