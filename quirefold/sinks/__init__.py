"""Visual JSON, HTML and file output."""
