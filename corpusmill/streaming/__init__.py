"""File-stream versions of the batch operators."""
