"""DataFrame in, DataFrame out: the single steps of grading."""
