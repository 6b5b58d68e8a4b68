"""Named queries; programs adds those of the batch programs to the same registry."""
