"""Files in and out: CSV, COPY text, tagged documents, dumps."""
