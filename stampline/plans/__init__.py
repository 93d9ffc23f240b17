"""Domain views and the registered queries."""
