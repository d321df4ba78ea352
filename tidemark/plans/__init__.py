"""Query planning, the registered queries and their SQL."""
