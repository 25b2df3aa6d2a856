"""Native Column expressions: graph operations, normal tails, transforms, hashes, checks, rounding."""
