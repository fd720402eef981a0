"""Layout operators on tables of elements."""
