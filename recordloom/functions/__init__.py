"""Column functions: text, stems, similarity and keys."""
