"""molframe: DataFrame operators for very large tables of labelled sequences and small graphs."""
