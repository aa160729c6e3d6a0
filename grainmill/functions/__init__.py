"""Column functions: text normalization, overlap metrics, judge-output parsing, vectors. Built-in expressions only unless said."""
