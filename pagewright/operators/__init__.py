"""DataFrame transforms over page tables."""
