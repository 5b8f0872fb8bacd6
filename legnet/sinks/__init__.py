"""Writers: each sink renders a DataFrame to rows of text on the executors."""
