"""Tables of layout elements from text, relations, HTML and PDF files."""
