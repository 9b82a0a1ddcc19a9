"""Operations for large training corpora: ten operators, their queries, and the corpus pipeline's building blocks."""
