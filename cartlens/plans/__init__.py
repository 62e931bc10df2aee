"""Job entry and the query registry."""
