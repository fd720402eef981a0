"""Layout of files as they arrive."""
