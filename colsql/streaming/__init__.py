"""Live queries and buffered writers."""
